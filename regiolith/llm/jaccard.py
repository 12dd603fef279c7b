"""Exact similarity join of documents on word shingles, with set relations to skip work.

Documents become sets of 4-word shingles. Equal sets form a class with a number of its own, and one set of each
class stays. Then

1. hubs: sets that share one of a few least hashes are compared with the least class of that group; the ones
   similar enough are satellites of their hub at a known distance, and hub and satellites are one component;
2. prefixes: under one global order of shingles (frequent ones last) two similar sets share a shingle of their
   prefixes. Index lists are keyed by shingle and cut into blocks by size; a list is entered once for each hub. The
   position of the shingle in a set bounds the sizes of the sets that it can still be similar to, so an entry is
   joined with the blocks between its bounds and skips all others: the later the position, the fewer the blocks.
   Lists within one component are skipped altogether;
3. answers: Jaccard distance is a metric, so the distance of two hubs, less their radii, bounds the distance of
   all pairs of their satellites. Only hub pairs are compared; satellites are compared only where the bound
   leaves a link open and the two are not yet connected.

No candidate is capped or dropped: bounds are exact (sizes, positions, parities of hashed bits, the triangle
inequality), and every link is decided on whole sets. Classes that stand in many pairs are dealt out in parts.

A null or empty text, or one without words, has an empty set and is linked with nothing. Repeated rows get the
same component; rows that share a doc_id and differ in text are rows of their own. A row without doc_id is returned
with a null component and takes no part. An empty table gives no rows. ``one_of_each`` keeps all columns of its input.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regiolith.llm.common import checkpointed, map_rows, table, texts
from regiolith.llm.components import components
from regiolith.llm.shingles import WordHashes, shingle_set

WORDS = 4
PERCENT = 85
#: Shingles that count as frequent and come last in the order, rarest first; bounds what is broadcast (32 MB).
FREQUENT = 2_000_000
#: A shingle is frequent only from so many sets on.
FREQUENT_FROM = 8
#: Ids up to which a set of wanted documents is broadcast, after they were counted.
BROADCAST_IDS = 500_000
#: Pairs of one class that go to one task.
SHARE = 256
LEAST_BITS = 256
EPSILON = 1e-9
# Odd multipliers, one for each choice of least hash.
CHOICES = np.array([1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n that any set similar enough must share at least one of, in a common order."""
    return n - (percent * n + 99) // 100 + 1


def parity_bits(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles that fall on each of a power of two of places, as packed bits."""
    bits = LEAST_BITS
    while bits < len(s):
        bits *= 2
    hits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from parities; the longer ones are folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def coarse_parities(bits: bytes) -> list[int]:
    """The parities folded to 256 places, as four signed longs that Spark can compare by itself."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > LEAST_BITS // 8:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return np.frombuffer(x.tobytes(), "<i8").tolist()


COARSE = [f"c{i}" for i in range(LEAST_BITS // 64)]


def coarse_bound(x: str, y: str) -> Column:
    """A lower bound of the Jaccard distance of two sets with the columns n and COARSE under the prefixes x and y."""
    na, nb = F.col(f"{x}n"), F.col(f"{y}n")
    odd = sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in COARSE[1:]), F.bit_count(F.col(f"{x}c0").bitwiseXOR(F.col(f"{y}c0"))))
    shared = (na + nb - F.greatest(odd.cast("long"), F.abs(na - nb))) / 2
    return 1 - shared / (na + nb - shared)


def signed(s: np.ndarray) -> list[int]:
    return s.view(np.int64).tolist()


def identity(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two signed longs."""
    key = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def set_table(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, k1, k2, leasts, bits, coarse, prefix): size, identity, least hashes, parities and prefix of each set."""

    def task():
        hashes = WordHashes()

        def step(block):
            names = ("doc_id", "n", "k1", "k2", "leasts", "bits", "coarse", "prefix")
            out = {k: [] for k in names}
            for doc_id, text in zip(block["doc_id"], block["text"]):
                s = shingle_set(text, words, hashes)
                k1, k2 = identity(s)
                out["doc_id"].append(doc_id)
                out["n"].append(len(s))
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["leasts"].append([int((s * c).min().astype(np.int64)) for c in CHOICES] if len(s) else [])
                out["bits"].append(bits := parity_bits(s))
                out["coarse"].append(coarse_parities(bits))
                out["prefix"].append(signed(s[: prefix_length(len(s), percent)]) if len(s) else [])
            return out

        return step

    return map_rows(
        texts(docs), task, "doc_id long, n long, k1 long, k2 long, leasts array<long>, bits binary, coarse array<long>, prefix array<long>"
    )


def of_classes(docs: DataFrame, wanted: DataFrame, wanted_rows: int, twice: bool) -> DataFrame:
    """(rep, k1, k2, text): the texts of the least doc_id of each wanted class (rep, doc_id, k1, k2). Rows that only share
    the doc_id come along; their sets tell them apart. ``twice``: one of such rows may occur twice."""
    rows = texts(docs).join(sized(wanted, wanted_rows), "doc_id").select("rep", "k1", "k2", "text")
    return rows.dropDuplicates(["rep", "text"]) if twice else rows


def ordered_prefixes(docs: DataFrame, frequent: np.ndarray, often: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, k1, k2, n, prefix) with the frequent shingles (sorted by hash, with their counts) last, rarest first."""

    def task():
        hashes = WordHashes()

        def step(block):
            out = {"doc_id": block["doc_id"], "k1": [], "k2": [], "n": [], "prefix": []}
            for text in block["text"]:
                s = shingle_set(text, words, hashes)
                k1, k2 = identity(s)
                if len(s) and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    last = frequent[at] == s
                    by_count = np.lexsort((s[last], often[at[last]]))
                    s = np.concatenate([s[~last], s[last][by_count]])
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["n"].append(len(s))
                out["prefix"].append(signed(s[: prefix_length(len(s), percent)]) if len(s) else [])
            return out

        return step

    return map_rows(texts(docs), task, "doc_id long, k1 long, k2 long, n long, prefix array<long>")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def set_arrays(chosen: DataFrame, words: int) -> DataFrame:
    """(rep, s) of rows of ``of_classes``."""

    def task():
        hashes = WordHashes()

        def step(block):
            out = {"rep": [], "s": []}
            for rep, k1, k2, text in zip(*(block[c] for c in ("rep", "k1", "k2", "text"))):
                s = shingle_set(text, words, hashes)
                if identity(s) == (k1, k2):
                    out["rep"].append(rep)
                    out["s"].append(signed(s))
            return out

        return step

    return map_rows(chosen, task, "rep long, s array<long>")


def crowded(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(rep, parts) of the classes in more than SHARE of the pairs (a, b), and how many they are: fewer than two SHARE-ths
    of the pairs. Such a class is dealt out in parts of about SHARE pairs, each with its own copy of the class's row."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").count()
    hot = checkpointed(ends.where(F.col("count") > SHARE).select("rep", F.ceil(F.col("count") / SHARE).alias("parts")))
    return hot, hot.count()


def with_side(pairs: DataFrame, rows: DataFrame, side: str, hot: DataFrame, hot_rows: int) -> DataFrame:
    """Pairs joined with the rows (rep, ...) of one side, whose columns get the side's name as a prefix."""
    columns = [F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "rep"]
    if not hot_rows:
        return pairs.join(rows.select(F.col("rep").alias(side), *columns), side)
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(sized(hot.withColumnRenamed("rep", side), hot_rows), side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts)).drop("parts")
    right = rows.join(sized(hot, hot_rows), "rep", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return left.join(right.select(F.col("rep").alias(side), "part", *columns), [side, "part"]).drop("part")


def possible(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame, hot_rows: int) -> DataFrame:
    """Pairs (a, b, slack) whose parities leave a distance within the slack open: what the threshold is widened by.

    ``sets`` has (rep, n, bits)."""
    rows = sets.select("rep", "n", "bits")
    joined = with_side(with_side(pairs.select("a", "b", "slack"), rows, "a", hot, hot_rows), rows, "b", hot, hot_rows)
    limit = 1 - percent / 100

    def task():
        def step(block):
            out = {"a": [], "b": []}
            for a, b, na, nb, x, y, slack in zip(*(block[k] for k in ("a", "b", "a_n", "b_n", "a_bits", "b_bits", "slack"))):
                least = max(least_difference(x, y), abs(na - nb))
                most_shared = (na + nb - least) / 2
                if 1 - most_shared / (na + nb - most_shared) <= limit + slack + EPSILON:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    return map_rows(joined, task, "a long, b long", rows=4096)


class Corpus:
    """The documents and their classes (rep, doc_id, k1, k2, n, bits, ...), for comparing whole sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int):
        self.docs, self.classes, self.words, self.percent = docs, classes, words, percent
        self.twice = bool(classes.where("same > 1").limit(1).count())

    def texts_of(self, wanted: DataFrame, rows: int) -> DataFrame:
        return of_classes(self.docs, wanted.select("rep", "doc_id", "k1", "k2"), rows, self.twice)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked, distance) of distinct pairs of classes (a, b, slack), decided on their whole sets."""
        pairs = checkpointed(pairs)
        hot = crowded(pairs)
        pairs = checkpointed(possible(pairs, self.classes, self.percent, *hot))
        ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        wanted = checkpointed(self.classes.join(ids, "rep", "left_semi").select("rep", "doc_id", "k1", "k2"))
        sets = checkpointed(set_arrays(self.texts_of(wanted, wanted.count()), self.words))
        both = with_side(with_side(pairs, sets, "a", *hot), sets, "b", *hot)
        shared = both.select("a", "b", (F.size("a_s") + F.size("b_s")).alias("total"), F.size(F.array_intersect("a_s", "b_s")).alias("shared"))
        union = F.col("total") - F.col("shared")
        return shared.select("a", "b", (100 * F.col("shared") >= self.percent * union).alias("linked"), (1 - F.col("shared") / union).alias("distance"))


def size_block(n: Column, percent: int) -> Column:
    """Number of the block of a size; the sizes of a block differ by the threshold's ratio at most."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / -math.log(percent / 100)).cast("long")


def linked_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, k1, k2, root, component_id) of every row: its set's size and identity, the class that names its
    component, and the least doc_id of that; the last two are null for an empty set or without doc_id."""
    limit = 1 - percent / 100
    rows = checkpointed(set_table(docs, words, percent))
    usable = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = {c: F.first(c).alias(c) for c in ("n", "leasts", "bits", "coarse")}
    by_id = usable.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("same"), *first.values())
    classes = checkpointed(
        by_id.groupBy("k1", "k2")
        .agg(F.min(F.struct("doc_id", "same")).alias("x"), *first.values())
        .select(F.monotonically_increasing_id().alias("rep"), "x.doc_id", "x.same", "k1", "k2", *first)
    )
    corpus = Corpus(docs, classes, words, percent)
    coarse = [F.get("coarse", F.lit(i)).alias(c) for i, c in enumerate(COARSE)]

    # 1. hubs
    chosen = classes.select("rep", "doc_id", F.posexplode("leasts").alias("choice", "least"))
    least_class = F.min(F.struct("doc_id", "rep")).alias("x")
    groups = chosen.groupBy("choice", "least").agg(least_class, F.count(F.lit(1)).alias("sets")).where("sets > 1")
    groups = checkpointed(groups.select("choice", "least", F.col("x.rep").alias("hub"), "sets"))
    large = checkpointed(groups.where(F.col("sets") > SHARE))  # fewer than a SHARE-th of the sets and choices
    many = large.count()
    near = chosen.join(groups.where(F.col("sets") <= SHARE), ["choice", "least"])
    if many:
        near = near.unionByName(chosen.join(sized(large, many), ["choice", "least"]))
    near = near.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"), F.lit(0.0).alias("slack")).distinct()
    hub_links = checkpointed(corpus.distances(near).where("linked"))
    own_hub = checkpointed(hub_links.groupBy(F.col("a").alias("rep")).agg(F.min(F.struct(F.col("b").alias("hub"), F.col("distance").alias("r"))).alias("x")).select("rep", "x.hub", "x.r"))
    # A set goes with its own hub, so only links of hubs, and of own hubs with other hubs, are left to contract.
    hub_ids = hub_links.select(F.col("b").alias("rep")).distinct()
    of_hubs = hub_links.join(hub_ids.withColumnRenamed("rep", "a"), "a", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"))
    between = hub_links.join(own_hub.select(F.col("rep").alias("a"), F.col("hub").alias("u")), "a").select("u", F.col("b").alias("v"))
    contracted = components(of_hubs.unionByName(between).where("u <> v").distinct())
    placed = checkpointed(
        classes.select("rep", "doc_id", "k1", "k2", "n", *coarse)
        .join(own_hub, "rep", "left")
        .withColumn("hub", F.coalesce("hub", "rep"))
        .join(contracted.withColumnsRenamed({"node": "hub", "component": "comp"}), "hub", "left")
        .select("rep", "doc_id", "k1", "k2", "n", *COARSE, "hub", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("comp", "hub").alias("comp"))
    )

    # 2. prefixes, frequent shingles last
    counts = usable.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count()
    total = usable.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    least = max(FREQUENT_FROM, total // FREQUENT + 1)  # so at most FREQUENT shingles reach it
    top = counts.where(F.col("count") >= least).toArrow()
    frequent = top.column("shingle").to_numpy().view(np.uint64)
    by_hash = np.argsort(frequent)
    frequent, often = frequent[by_hash], top.column("count").to_numpy()[by_hash]
    prefixes = ordered_prefixes(docs, frequent, often, words, percent)
    entries = (
        prefixes.join(placed.select("doc_id", "k1", "k2", "hub", "comp"), ["doc_id", "k1", "k2"])
        .select("hub", "comp", "n", F.posexplode("prefix").alias("at", "shingle"))
        .repartition("shingle")
        .groupBy("shingle", "comp", "hub")
        .agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("at")).alias("rest"))
    )
    whole = Window.partitionBy("shingle")
    lists = checkpointed(
        entries.withColumn("low", F.min("comp").over(whole)).withColumn("high", F.max("comp").over(whole)).where("low < high").drop("low", "high")
    )
    radii = placed.groupBy("hub").agg(F.max("r").alias("radius"))
    hubs = checkpointed(classes.select(F.col("rep").alias("hub"), "n", *coarse).join(radii, "hub"))
    lists = checkpointed(lists.join(hubs, "hub"))
    x, y = (lists.select([F.col(c).alias(f"{side}_{c}") for c in lists.columns]) for side in "xy")
    # What an entry at this position can be similar to: sizes from share * n, and up to n / share or what the rest of the set allows.
    smallest = F.floor(percent * F.col("x_least_n") / 100)
    largest = F.least(F.ceil(100 * F.col("x_most_n") / percent), F.ceil((100 + percent) * F.col("x_rest") / percent) - F.col("x_least_n"))
    x = x.where(smallest <= largest).withColumn("block", F.explode(F.sequence(size_block(smallest, percent), size_block(largest, percent))))
    y = y.withColumn("y_block", F.explode(F.sequence(size_block(F.col("y_least_n"), percent), size_block(F.col("y_most_n"), percent))))
    near_sizes = (100 * F.col("x_most_n") >= percent * F.col("y_least_n")) & (100 * F.col("y_most_n") >= percent * F.col("x_least_n"))
    near_places = (100 + percent) * F.least("x_rest", "y_rest") >= percent * (F.col("x_least_n") + F.col("y_least_n"))
    near_bits = coarse_bound("x_", "y_") <= limit + F.col("x_radius") + F.col("y_radius") + EPSILON
    same_block = (F.col("x_shingle") == F.col("y_shingle")) & (F.col("block") == F.col("y_block"))
    pairs = (
        x.join(y, same_block & (F.col("x_comp") < F.col("y_comp")) & near_sizes & near_places & near_bits)
        .select(F.col("x_hub").alias("a"), F.col("y_hub").alias("b"), (F.col("x_radius") + F.col("y_radius")).alias("slack"))
        .distinct()
    )

    # 3. answers: hubs first, satellites where the bounds leave a link open
    hub_pairs = checkpointed(corpus.distances(pairs))
    comp_of = placed.select(F.col("rep").alias("node"), "comp")
    second_edges = checkpointed(
        hub_pairs.where("linked")
        .join(comp_of.withColumnsRenamed({"node": "a", "comp": "u"}), "a")
        .join(comp_of.withColumnsRenamed({"node": "b", "comp": "v"}), "b")
        .select("u", "v")
        .distinct()
    )
    second = components(second_edges).withColumnsRenamed({"node": "comp", "component": "joined"})
    now = checkpointed(placed.join(second, "comp", "left").withColumn("comp", F.coalesce("joined", "comp")).drop("joined"))
    side = lambda df, name, keys: df.select([F.col(c).alias(keys.get(c, f"{name}_{c}")) for c in df.columns])
    comps = now.groupBy("hub").agg(F.first("comp").alias("comp"))
    apart = (
        hub_pairs.where("not linked")
        .join(side(hubs.drop("radius").join(comps, "hub"), "h", {"hub": "b"}), "b")
        .join(side(hubs.select("hub", "radius"), "b", {"hub": "b"}), "b")
        .join(comps.withColumnsRenamed({"hub": "a", "comp": "a_comp"}), "a")
        .where("a_comp <> h_comp")
    )
    parts = now.select("hub", "rep", "r", "n", *COARSE)
    left, right = side(parts, "s", {"hub": "of_a"}), side(parts, "t", {"hub": "of_b"})
    one_side = (
        (F.col("a") == F.col("of_a"))
        & (F.col("distance") - F.col("s_r") - F.col("b_radius") <= limit + EPSILON)
        & (coarse_bound("s_", "h_") <= limit + F.col("b_radius") + EPSILON)
    )
    both_sides = (F.col("b") == F.col("of_b")) & (F.col("distance") - F.col("s_r") - F.col("t_r") <= limit + EPSILON) & (coarse_bound("s_", "t_") <= limit + EPSILON)
    open_pairs = apart.join(left, one_side).join(right, both_sides).select(F.col("s_rep").alias("a"), F.col("t_rep").alias("b"), F.lit(0.0).alias("slack")).distinct()
    late = corpus.distances(open_pairs).where("linked")
    comp_now = now.select(F.col("rep").alias("node"), "comp")
    third_edges = (
        late.join(comp_now.withColumnsRenamed({"node": "a", "comp": "u"}), "a")
        .join(comp_now.withColumnsRenamed({"node": "b", "comp": "v"}), "b")
        .select("u", "v")
        .distinct()
    )
    third = components(third_edges).withColumnsRenamed({"node": "comp", "component": "joined"})
    named = now.join(third, "comp", "left").select("doc_id", "k1", "k2", F.coalesce("joined", "comp").alias("root"))
    joint = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    joint = checkpointed(joint.where("classes > 1").select("root", "component_id"))  # a class alone has its own least doc_id
    named = named.join(sized(joint, joint.count()), "root", "left").select("k1", "k2", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
    return (
        rows.select("doc_id", "n", "k1", "k2")
        .join(named, ["k1", "k2"], "left")
        .withColumns({c: F.when(F.col("doc_id").isNotNull(), F.col(c)) for c in ("root", "component_id")})
    )


def linked_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the least doc_id that its links reach, its own for an empty set."""
    return linked_rows(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The row with the least doc_id of each component, and all that have no words or no doc_id.

    Of equal rows one stays; of a component's sets that share the least doc_id, one by a hash."""
    rows = checkpointed(linked_rows(docs, words, percent).select("doc_id", "k1", "k2", "root"))
    best = checkpointed(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("best")).select("best.*"))
    ids = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("root").alias("root"))
    repeated = checkpointed(ids.where("rows > 1").select("doc_id"))
    leave = checkpointed(ids.where("rows = 1 and root is not null").join(best.select("doc_id"), "doc_id", "left_anti").select("doc_id"))
    kept = docs.join(sized(leave, leave.count()), "doc_id", "left_anti").select(docs.columns)
    again = repeated.count()
    if not again:
        return kept
    hint = sized(repeated, again)
    mine = kept.join(hint, "doc_id", "left_semi").select(docs.columns)
    keyed = with_identity(mine, words)
    empty = keyed.where(F.col("__n") == 0)
    chosen = keyed.where(F.col("__n") > 0).join(best.select("doc_id", F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), ["doc_id", "__k1", "__k2"], "left_semi")
    once = empty.unionByName(chosen.dropDuplicates(["doc_id", "__k1", "__k2"])).select(docs.columns)
    return kept.join(hint, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def with_identity(docs: DataFrame, words: int) -> DataFrame:
    """All columns of the input, and the size and identity of each set as __n, __k1 and __k2."""

    def task():
        hashes = WordHashes()

        def step(block):
            sets = [shingle_set(t or "", words, hashes) for t in block["text"]]
            keys = [identity(s) for s in sets]
            return block | {"__n": [len(s) for s in sets], "__k1": [k for k, _ in keys], "__k2": [k for _, k in keys]}

        return step

    return map_rows(docs, task, docs.schema.toDDL() + ", __n long, __k1 long, __k2 long")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))
