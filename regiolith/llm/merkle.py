"""Merkle manifest of a dataset: a ternary tree for each source, and one over the sources' roots.

Leaves are digests of rows, ranked within their source by a range sort. A tree is built by aligned builders: each takes
3 ** ``LEVELS`` consecutive nodes, which are one whole subtree, and appends digests to its log in the order in which they
are complete (postorder). The roots of the builders are the nodes of the next round, until every tree has one; a source
that holds most rows is so spread over many builders. A node's place in a log has a closed form in the sizes of the
subtrees before it, so proofs take siblings from the logs by address: from the upper tree down, each round hands the
paths of its nodes to the builders below, and the last one folds the leaves.

A null field counts as ``-``. Rows without a source are a source of their own, before all others. Rows of one doc_id are
ordered by their leaves, rows without doc_id come first; equal rows are leaves of their own. An empty table has no trees
and gives no rows. Further columns are ignored. A text of any length is hashed where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from regiolith.llm.common import checkpointed, table

#: Children of a node, and levels that a builder makes.
ARITY, LEVELS = 3, 6
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: bytes) -> bytes:
    """The digest of digests as hex text."""
    return sha256(parts.hex().encode()).digest()


def nodes_at(level: int, n: int) -> int:
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while nodes_at(level, n) > 1:
        level += 1
    return level


def address(level: int, i: int, n: int, levels: int) -> int:
    """The place of node i of a level in the postorder log of n leaves: all nodes complete by then, less one.

    Up to its own level these are the nodes over the leaves up to its last one; above it, those that end before its
    first one."""
    first, last = i * ARITY**level, min((i + 1) * ARITY**level, n)
    below = sum(nodes_at(j, last) for j in range(level + 1))
    return below + sum(first // ARITY**j for j in range(level + 1, levels + 1)) - 1


def postorder_log(leaves: list[bytes], levels: int) -> bytes:
    """The digests of a tree of so many levels in the order of their completion; the last is the root."""
    log, open_runs = [], [[] for _ in range(levels + 1)]

    def add(level: int, value: bytes) -> None:
        log.append(value)
        open_runs[level].append(value)

    def close(level: int) -> None:
        value = digest(b"".join(open_runs[level]))
        open_runs[level].clear()
        add(level + 1, value)

    for leaf in leaves:
        add(0, leaf)
        level = 0
        while level < levels and len(open_runs[level]) == ARITY:
            close(level)
            level += 1
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return b"".join(log)


def path_in_log(log: bytes, i: int, n: int, levels: int) -> Iterator[tuple[bytes, bytes]]:
    """(siblings to the left, to the right) of leaf i and of each node above it but the root, from the log."""
    for level in range(levels):
        first = i - i % ARITY
        last = min(first + ARITY, nodes_at(level, n))
        siblings = [log[SIZE * at : SIZE * at + SIZE] for at in (address(level, k, n, levels) for k in range(first, last))]
        yield b"".join(siblings[: i - first]), b"".join(siblings[i - first + 1 :])
        i //= ARITY


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds rank (from 0) and size of the rows of each key, which is not null.

    Rows are sorted by range partitions; a key with most rows lies in many of them, so each is numbered by itself and
    shifted by the rows of its key in those before. The table of shifts has a row for each key and partition."""
    cut = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    cut = checkpointed(cut.withColumn("part__", F.spark_partition_id()).withColumn("row__", F.monotonically_increasing_id()))
    sizes = cut.groupBy(key, "part__").agg(F.count(F.lit(1)).alias("n__"), F.min("row__").alias("first__"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "part__", (F.coalesce(F.sum("n__").over(before), F.lit(0)) - F.col("first__")).alias("shift__"), F.sum("n__").over(whole).alias("size"))
    return cut.join(shifts, [key, "part__"]).withColumn("rank", F.col("row__") + F.col("shift__")).drop("part__", "row__", "shift__")


def arrow_of(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def table_of(arrow: pa.Schema, columns: dict[str, list]) -> pa.Table:
    return pa.table([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


BLOCK = "tree string, rank long, size long, digest binary, n int, levels int, log binary"


def build_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One builder for each ARITY ** levels consecutive nodes (tree, rank, size, digest): its log, and its root as a node."""
    width, arrow = ARITY**levels, arrow_of(BLOCK)

    def build(key, group):  # a key and a pyarrow.Table; hints would be taken for a choice of the kind of function
        rows = group.select(["rank", "size", "digest"]).sort_by("rank")
        size = rows["size"][0].as_py()
        own = levels if size > width else height(size)
        log = postorder_log(rows["digest"].to_pylist(), own)
        made = {"tree": key[0].as_py(), "rank": key[1].as_py(), "size": -(-size // width), "digest": log[-SIZE:], "n": rows.num_rows, "levels": own, "log": log}
        return table_of(arrow, {k: [v] for k, v in made.items()})

    blocks = nodes.select("tree", F.expr(f"rank div {width}").alias("block"), "rank", "size", "digest")
    return blocks.groupBy("tree", "block").applyInArrow(build, BLOCK)


def build_trees(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The blocks of each round; those of the last are one for each tree."""
    most = nodes.agg(F.max("size")).first()[0] or 1
    rounds = []
    while True:
        rounds.append(checkpointed(build_blocks(nodes, levels)))
        most = -(-most // ARITY**levels)
        if most <= 1:
            return rounds
        nodes = rounds[-1]


PATH = "tree string, rank long, left array<binary>, right array<binary>"


def paths_below(blocks: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The paths of the nodes of a round, from those of its blocks, a level an entry. Further columns of paths go along."""
    width, extra = ARITY**levels, [f for f in paths.schema if f.name not in ("tree", "rank", "left", "right")]
    schema = ", ".join([PATH, *[f"{f.name} {f.dataType.simpleString()}" for f in extra]])
    arrow, names = arrow_of(schema), [f.name for f in extra]

    def expand(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for i in range(row["n"]):
                    own = list(path_in_log(row["log"], i, row["n"], row["levels"]))
                    left, right = [x for x, _ in own] + row["left"], [x for _, x in own] + row["right"]
                    made = {"tree": row["tree"], "rank": row["rank"] * width + i, "left": left, "right": right}
                    made |= {k: row[k] for k in names}
                    yield from table_of(arrow, {k: [v] for k, v in made.items()}).to_batches()

    return blocks.join(paths, ["tree", "rank"]).mapInArrow(expand, schema)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of each field as its count of bytes and its value, or ``-``."""
    parts = []
    for c in fields.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered): a row's leaf, and that of its text without line ends where its id is even by crc32."""
    fields = {c: F.col(c) for c in FIELDS}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_digest(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # null first, then by bytes
    return docs.select(
        tree.alias("tree"), "doc_id", leaf_digest(fields).alias("digest"), F.when(even & F.col("text").contains("\n"), changed).alias("tampered")
    )


class Manifest:
    """The leaves with their ranks, the logs of the trees of all sources, and those of the tree over them."""

    def __init__(self, docs: DataFrame, levels: int = LEVELS):
        self.levels = levels
        self.leaves = checkpointed(ranked(checkpointed(leaves(docs)), "tree", ["doc_id", "digest"]))
        self.rounds = build_trees(self.leaves, levels)
        self.subroots = self.rounds[-1].select("tree", F.col("digest").alias("subroot"))
        tops = ranked(self.subroots.select(F.lit("").alias("top"), "tree", "subroot"), "top", ["tree"])
        self.sources = checkpointed(tops.select("tree", "subroot", "rank", "size"))  # a row for each source
        self.upper = build_trees(self.sources.select(F.lit("").alias("tree"), "rank", "size", F.col("subroot").alias("digest")), levels)
        self.root = self.upper[-1].select(F.col("digest").alias("root"))  # one row, or none

    def block_paths(self) -> DataFrame:
        """(tree, rank, left, right, subroot, root) of the blocks of the first round: their paths up to the root."""
        none = F.array().cast("array<binary>")
        paths = self.upper[-1].select("tree", "rank", none.alias("left"), none.alias("right"), F.col("digest").alias("root"))
        for blocks in reversed(self.upper):
            paths = paths_below(blocks, paths, self.levels)
        ends = paths.drop("tree").join(self.sources.select("tree", "subroot", "rank"), "rank")
        paths = ends.select("tree", F.lit(0).cast("long").alias("rank"), "left", "right", "subroot", "root")
        for blocks in reversed(self.rounds[1:]):
            paths = paths_below(blocks, paths, self.levels)
        return paths

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, tampered, subroot, root, left, right) of every row: the siblings of each level."""
        return self.with_leaves("doc_id long, leaf binary, tampered binary, subroot binary, root binary, left array<binary>, right array<binary>", lambda x: x)

    def verified(self) -> DataFrame:
        """Every row with the digest of its proof, and what its tampered leaf folds to, as hex."""

        def judged(x: dict) -> dict:
            path = list(zip(x["left"], x["right"]))
            folded = fold(x["tampered"] or x["leaf"], path)
            made = {"leaf": x["leaf"], "subroot": x["subroot"], "root": x["root"], "proof_sha256": digest(b"".join(a + b for a, b in path)), "folded_root": folded}
            return {"doc_id": x["doc_id"], "verified": folded == x["root"]} | {k: v.hex() for k, v in made.items()}

        return self.with_leaves("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", judged)

    def with_leaves(self, schema: str, row) -> DataFrame:
        """The rows of ``row`` for every leaf with its path; leaves meet the log of their block."""
        width, arrow = ARITY**self.levels, arrow_of(schema)

        def meet(key, members, block):
            b = block.to_pylist()[0]
            out: dict[str, list] = {f.name: [] for f in arrow}
            for m in members.to_pylist():
                path = list(path_in_log(b["log"], m["rank"] % width, b["n"], b["levels"]))
                left, right = [x for x, _ in path] + b["left"], [x for _, x in path] + b["right"]
                made = row({"doc_id": m["doc_id"], "leaf": m["digest"], "tampered": m["tampered"], "subroot": b["subroot"], "root": b["root"], "left": left, "right": right})
                for name in out:
                    out[name].append(made[name])
            return table_of(arrow, out)

        members = self.leaves.withColumn("block", F.expr(f"rank div {width}"))
        blocks = self.rounds[0].join(self.block_paths(), ["tree", "rank"]).withColumnRenamed("rank", "block")
        return members.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(meet, schema)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Manifest(table(spark, sf_dir, "documents")).verified()
