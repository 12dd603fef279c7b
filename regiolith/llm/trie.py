"""Prefix trie of conversations by union-find over the shared prefixes of sorted neighbours.

A turn is a digest of 128 bits of role and text, a conversation the chain of its turns' digests. Equal conversations are one
sequence. Sequences are sorted by range partitions; the longest common prefix (LCP) of two neighbours is an edge. In
each partition edges are taken in descending depth: an edge joins the components on its two sides into the node at its
depth, and a component that is deeper than the edge is a whole node with all its chain above, which is then given out.
What touches a neighbouring partition deeper than an edge must wait: the partition keeps a contracted forest of the
components along its two borders, whose edges only fall towards its middle, so there are at most twice as many as the
deepest border. Forests of neighbouring partitions are merged the same way, round by round, until one is left.

A node's sums come from its members and their new turns alone, so a component carries a few numbers: with S the words of
all members, N those of turns that members do not share with their left neighbour, b the words that the first member
shares with its left neighbour and c the words above the node, saved tokens are S - N - b - (members - 1) * c.

Turns without a number come first; turns of one number are ordered by role, then by the digest of their text. Null role
and text are empty; repeated rows are repeated turns. Rows without conv_id belong to no conversation and are left out.
An empty table has no trie, not even a root. Further columns are ignored. A turn's text of any length is hashed where it
is read; a conversation is one row of 36 bytes a turn.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass, fields
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiolith.llm.common import checkpointed, table
from regiolith.llm.merkle import arrow_of, table_of

#: Conversations of one block take their first turns from its first one; at most so many.
BLOCK_OF, HEAD = 20, 4
#: Characters of a turn's digest as hex text.
WIDE = 32
#: Forests that are merged in one task, and ids of one chunk of an end list.
FAN, CHUNK = 32, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, token, words>>) of each conversation, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, WIDE)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    one = F.struct(F.col("turn").alias("turn"), role.alias("role"), token.alias("token"), words.alias("words"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, path, words): each conversation with the first turns of its block's first conversation in place of its
    own; path is the chain of digests, words those of each turn."""
    turns = checkpointed(turn_rows(rows).select("conv_id", F.expr("transform(turns, x -> struct(x.token, x.words))").alias("turns")))
    first = turns.where(F.col("conv_id") % BLOCK_OF == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEAD - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    joined = turns.withColumn("h", h.cast("int")).withColumn("first", F.col("conv_id") - F.col("conv_id") % BLOCK_OF).join(first, "first", "left")
    none = F.slice("turns", 1, 0)
    made = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return joined.withColumn("made", made).select("conv_id", F.array_join("made.token", "").alias("path"), F.col("made.words").alias("words"))


def end_digests(members: DataFrame) -> DataFrame:
    """(key, ends) of rows (key, conv_id): the digest of a key's ids in ascending order.

    Ids are sorted by range partitions and joined to texts of CHUNK ids there; one task then hashes the texts of a key in
    order, as a digest is made from front to back, and holds one text at a time."""
    arrow, final = arrow_of("key string, first long, ids string"), arrow_of("key string, ends string")

    def chunks(batches):
        key, held = None, []

        def flush():
            return table_of(arrow, {"key": [key], "first": [held[0]], "ids": [",".join(map(str, held))]}).to_batches()

        for batch in batches:
            for k, c in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist()):
                if held and (k != key or len(held) == CHUNK):
                    yield from flush()
                    held = []
                key = k
                held.append(c)
        if held:
            yield from flush()

    def hashed(batches):
        key, sha = None, None
        for batch in batches:
            done: dict[str, list] = {"key": [], "ends": []}
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if k != key:
                    if key is not None:
                        done["key"].append(key)
                        done["ends"].append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield from table_of(final, done).to_batches()
        if key is not None:
            yield from table_of(final, {"key": [key], "ends": [sha.hexdigest()]}).to_batches()

    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = ranged.mapInArrow(chunks, "key string, first long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends string")


def sequences(conversations: DataFrame) -> DataFrame:
    """(path, words, n, conv_id, ends) of the distinct sequences: how many conversations have it, the least, and their digest."""
    keyed = checkpointed(conversations.withColumn("key", F.sha2(F.col("path").cast("binary"), 256)))
    groups = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")))
    shared = keyed.select("key", "conv_id").join(groups.where("n > 1").select("key"), "key", "left_semi")
    rows = keyed.select("conv_id", "path", "words").join(groups, "conv_id").join(end_digests(shared), "key", "left")
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    return rows.select("path", "words", "n", "conv_id", F.coalesce("ends", own).alias("ends"))


@dataclass
class Component:
    """Sequences that share a prefix of so many turns, in sorted order; left and right are the LCPs to what is beside it."""

    depth: int
    n: int
    conv_id: int
    total: int
    new: int
    before: int
    leaves: int
    children: int
    ends: str | None
    left: int
    right: int


COMPONENT = "depth int, n long, conv_id long, total long, new long, before long, leaves long, children long, ends string, left int, right int"
#: What a task gives: components that wait, and whole nodes with the depth of their parent. ``at`` is their order.
FOREST = f"part int, at int, parent int, {COMPONENT}"


def merged(a: Component, b: Component, depth: int) -> Component:
    """The node at a depth where two components meet; one that is as deep is a part of the node, a deeper one a child."""
    parts = [x for x in (a, b) if x.depth == depth]
    return Component(
        depth, a.n + b.n, min(a.conv_id, b.conv_id), a.total + b.total, a.new + b.new, a.before,
        sum(x.leaves for x in (a, b) if x.depth > depth or x.children), sum(1 if x.depth > depth else x.children for x in (a, b)),
        next((x.ends for x in parts if x.ends), None), a.left, b.right,
    )


def contracted(row: list[Component]) -> tuple[list[tuple[int, Component]], list[Component]]:
    """(whole nodes with their parents' depths, components that wait) of neighbouring components.

    Edges in descending depth, by union-find. An edge below a deeper one that waits must wait as well; the outer ones do."""
    up = list(range(len(row)))  # the component that a component has become a part of: the leftmost of its run
    last = list(range(len(row)))  # of a leftmost one, its rightmost

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    whole = []
    held_left, held_right = [-2] * len(row), [-2] * len(row)  # depths of edges that wait, by their side of a component
    if row:
        held_left[0], held_right[-1] = row[0].left, row[-1].right
    for i in sorted(range(1, len(row)), key=lambda i: -row[i].left):
        depth, a = row[i].left, find(i - 1)
        b = i  # an edge's right side begins with its own component
        if held_left[a] > depth or held_right[last[b]] > depth:
            held_right[last[a]] = held_left[b] = depth
            continue
        for x in (row[a], row[b]):
            if x.depth > depth:
                whole.append((depth, x))
        row[a] = merged(row[a], row[b], depth)
        up[b] = a
        last[a] = last[b]
    rest = [row[i] for i in range(len(row)) if up[i] == i]
    if len(rest) == 1 and rest[0].left < 0 and rest[0].right < 0:
        return [*whole, (-1, rest[0])], []
    return whole, rest


NAMES = [f.name for f in fields(Component)]


def forest_rows(arrow: pa.Schema, part: int, row: list[Component]) -> pa.Table:
    whole, rest = contracted(row)
    records = [(part, None, p, *astuple(x)) for p, x in whole] + [(part, at, None, *astuple(x)) for at, x in enumerate(rest)]
    columns = list(zip(*records)) or [()] * len(arrow)
    return table_of(arrow, {f.name: list(c) for f, c in zip(arrow, columns)})


def common(a: str, b: str) -> int:
    """Turns at the start of two paths that are the same."""
    n = min(len(a), len(b)) // WIDE
    low, high = 0, n
    while low < high:  # prefixes are equal up to a point and nowhere after it
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDE] == b[: mid * WIDE] else (low, mid - 1)
    return low


def border_depths(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """part -> LCPs of its first and last path with the paths beside them, -1 where there is none; two numbers a partition."""
    ends = ordered.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    w = Window.orderBy("part")  # one row a partition
    beside = ends.select("part", "low", "high", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    arrow = arrow_of("part int, left int, right int")

    def measured(batches):
        for batch in batches:
            out: dict[str, list] = {"part": [], "left": [], "right": []}
            for r in batch.to_pylist():
                out["part"].append(r["part"])
                out["left"].append(-1 if r["before"] is None else common(r["before"], r["low"]))
                out["right"].append(-1 if r["after"] is None else common(r["high"], r["after"]))
            yield from table_of(arrow, out).to_batches()

    return {r["part"]: (r["left"], r["right"]) for r in beside.mapInArrow(measured, "part int, left int, right int").collect()}


def compact_nodes(seqs: DataFrame) -> DataFrame:
    """The nodes where sequences branch or end: FOREST rows with the depth of the parent (-1 for what begins at the root)."""
    ordered = checkpointed(seqs.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    borders, arrow = border_depths(ordered), arrow_of(FOREST)
    if not borders:
        return ordered.sparkSession.createDataFrame([], FOREST)

    def first_forest(batches):
        row, part, path, sums = [], None, None, None
        for batch in batches:
            for r in batch.select(["part", "path", "words", "n", "conv_id", "ends"]).to_pylist():
                part = r["part"]
                left = borders[part][0] if path is None else common(path, r["path"])
                path, sums = r["path"], [0, *accumulate(r["words"])]
                if row:
                    row[-1].right = left
                shared = sums[max(left, 0)]
                row.append(Component(len(r["words"]), r["n"], r["conv_id"], r["n"] * sums[-1], sums[-1] - shared, shared, 1, 0, r["ends"], left, -1))
        if row:
            row[-1].right = borders[part][1]
            yield from forest_rows(arrow, part, row).to_batches()

    def next_forest(key, group):
        rows = group.sort_by([("part", "ascending"), ("at", "ascending")]).select(NAMES).to_pylist()
        return forest_rows(arrow, key[0].as_py(), [Component(**r) for r in rows])

    forest = checkpointed(ordered.mapInArrow(first_forest, FOREST))
    whole, parts = forest.where("at is null"), max(borders) + 1
    while parts > 1:
        waiting = forest.where("at is not null").withColumn("next", F.expr(f"part div {FAN}").cast("int"))
        forest = checkpointed(waiting.groupBy("next").applyInArrow(next_forest, FOREST))
        whole, parts = whole.unionByName(forest.where("at is null")), -(-parts // FAN)
    return whole


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node, see NODE; chains between branchings are given out turn by turn."""
    seqs = checkpointed(sequences(rebuilt(rows)))
    nodes = compact_nodes(seqs).drop("part", "at", "left", "right").join(seqs.select("conv_id", "path", "words"), "conv_id")
    prefix = lambda depth: F.sha2(F.substring("path", F.lit(1), WIDE * F.col(depth)).cast("binary"), 256)
    nodes = checkpointed(nodes.withColumn("key", prefix("depth")).withColumn("parent_key", F.when(F.col("parent") > 0, prefix("parent"))).drop("path"))
    least = nodes.agg(F.min("conv_id").alias("root_conv_id"))  # one row
    above = nodes.where("children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(above, "parent_key", "left").crossJoin(F.broadcast(least))
    top = F.when(F.col("parent") == 0, F.col("root_conv_id")).otherwise(F.col("parent_conv_id"))
    joined = joined.select("conv_id", "parent", "depth", "n", "children", "leaves", "ends", "words", top.alias("parent_conv_id"), (F.col("total") - F.col("new") - F.col("before")).alias("worth"))
    arrow = arrow_of(NODE)

    def chains(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sums = [0, 0, *accumulate(r["words"][: r["depth"]])]  # words above a depth
                depths = range(r["parent"] + 1, r["depth"] + 1)
                last = [d == r["depth"] for d in depths]
                yield from table_of(arrow, {
                    "conv_id": [r["conv_id"]] * len(depths), "depth": list(depths), "n_convs": [r["n"]] * len(depths), "n_leaves": [r["leaves"]] * len(depths),
                    "parent_conv_id": [r["parent_conv_id"] if d == r["parent"] + 1 else r["conv_id"] for d in depths],
                    "n_children": [r["children"] if x else 1 for x in last],
                    "saved_tokens": [r["worth"] - (r["n"] - 1) * sums[d] for d in depths],
                    "ends_sha256": [r["ends"] or NO_ENDS if x else NO_ENDS for x in last],
                }).to_batches()

    return joined.mapInArrow(chains, NODE)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
