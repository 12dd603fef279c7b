"""Index of alike names: all pairs whose indel ratio reaches a bound, without comparing all pairs.

The ratio is 100 * 2 * s / (a + b) with s the longest common subsequence of names of lengths a and b, so a ratio asks for
a common subsequence of a known length m(a, b). Names are joined by pairs of lengths that occur:

* deletions: two names have a common subsequence of m characters if and only if they share one of the texts that are left
  of them when all but m characters go. Where few texts are (``MOST_TEXTS``), these are the keys, and a shared key is a link.
* grams: otherwise keys are the rarest runs of q characters. A character that goes takes q runs with it, one that comes q - 1,
  so at least t runs are shared, and two names that share t runs share one of all but t - 1 of their rarest ones.

Both lose no pair. A similarity by Levenshtein distance over the longer length, or by matching blocks, is never above the
indel ratio, so the same index serves them.
"""

from __future__ import annotations

import itertools
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Texts of both names of a pair of lengths, up to which deletions are the keys.
MOST_TEXTS = 1000


def shared_length(a: Column, b: Column, ratio: float) -> Column:
    """The least common subsequence that gives the ratio."""
    return F.ceil(F.lit(ratio / 200) * (a + b) - 1e-9).cast("int")


def shared_by_edits(a: Column, b: Column, ratio: float) -> Column:
    """The least common subsequence that gives the similarity by Levenshtein distance over the longer length: what is not edited
    of the longer name is common. It is never below that of the same indel ratio, and rules out more pairs of lengths."""
    return F.ceil(F.lit(ratio / 100) * F.greatest(a, b) - 1e-9).cast("int")


def choices(n: Column, k: Column) -> Column:
    """n over k up to k = 4, and more than MOST_TEXTS beyond."""
    n = n.cast("double")
    return (
        F.when(k <= 0, 1.0).when(k == 1, n).when(k == 2, n * (n - 1) / 2).when(k == 3, n * (n - 1) * (n - 2) / 6)
        .when(k == 4, n * (n - 1) * (n - 2) * (n - 3) / 24).otherwise(F.greatest(n, F.lit(1.0)) * MOST_TEXTS)
    )


def length_pairs(left: DataFrame, right: DataFrame, ratio: float, shared=shared_length) -> DataFrame:
    """(block, a, b, m, q) of the lengths of names (block, name) that can be alike; q is 0 where deletions are the keys.

    Lengths are few, so this is a small table for each block."""
    a = left.select("block", F.length("name").alias("a")).distinct()
    b = right.select("block", F.length("name").alias("b")).distinct()
    x, y = F.col("a"), F.col("b")
    pairs = a.join(b, "block").withColumn("m", shared(x, y, ratio)).where((F.col("m") <= F.least("a", "b")) & (F.col("m") > 0))
    gone, come = x - F.col("m"), y - F.col("m")

    def some_left(q: int) -> Column:
        return (x - q + 1 > q * gone + (q - 1) * come) & (y - q + 1 > q * come + (q - 1) * gone)

    q = F.when(choices(x, gone) + choices(y, come) <= MOST_TEXTS, 0).when(some_left(3), 3).when(some_left(2), 2).otherwise(1)
    return pairs.withColumn("q", q)


def texts_left_column():
    """pandas UDF of a name and a number: all texts that are left when so many characters go."""

    @pandas_udf("array<string>")
    def texts_left(name: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([list({"".join(x) for x in itertools.combinations(s, len(s) - d)}) for s, d in zip(name, gone)])

    return texts_left


def runs_column():
    """pandas UDF of a name and q: its runs of q characters, the second one of a kind apart from the first."""

    @pandas_udf("array<string>")
    def runs(name: pd.Series, q: pd.Series) -> pd.Series:
        def one(s: str, n: int) -> list[str]:
            seen: Counter[str] = Counter()
            out = []
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                out.append(f"{g}\u0001{seen[g]}")
                seen[g] += 1
            return out

        return pd.Series([one(s, n) for s, n in zip(name, q)])

    return runs


def with_lengths(names: DataFrame, pairs: DataFrame, own: str, other: str) -> DataFrame:
    """Names for each pair of lengths that they have a part in: gone is what goes of them, come what goes of the other."""
    lengths = pairs.withColumn("gone", F.col(own) - F.col("m")).withColumn("come", F.col(other) - F.col("m"))
    return names.withColumn(own, F.length("name")).join(lengths, ["block", own])


def by_deletion(rows: DataFrame) -> DataFrame:
    return rows.where("q = 0").withColumn("key", F.explode(texts_left_column()("name", "gone")))


def by_grams(rows: DataFrame, often: DataFrame, own: str, other: str) -> DataFrame:
    """Rows (id, name, block, ...) of grams with their rarest runs as keys."""
    some = rows.where("q > 0")
    grams = some.select("id", "name", "q").distinct().withColumn("run", F.explode(runs_column()("name", "q")))
    ordered = grams.join(often, ["q", "run"]).groupBy("id", "q").agg(F.sort_array(F.collect_list(F.struct("count", "run"))).alias("ordered"))
    size_a, size_b = F.col(own) - F.col("q") + 1, F.col(other) - F.col("q") + 1
    lost = F.col("q") * F.col("gone") + (F.col("q") - 1) * F.col("come"), F.col("q") * F.col("come") + (F.col("q") - 1) * F.col("gone")
    shared = F.greatest(size_a - lost[0], size_b - lost[1], F.lit(1))
    keys = F.slice("ordered.run", F.lit(1), F.greatest(size_a - shared + 1, F.lit(0)))
    return some.join(ordered, ["id", "q"]).withColumn("key", F.explode(keys)).drop("ordered")


def gram_counts(*sides: DataFrame) -> DataFrame:
    """(q, run, count) over the names of all sides; the order of rarity."""
    every = None
    for rows in sides:
        part = rows.where("q > 0").select("name", "q").distinct().select("q", F.explode(runs_column()("name", "q")).alias("run"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("q", "run").count()


def likely_pairs(left: DataFrame, right: DataFrame, ratio: float, shared=shared_length) -> DataFrame:
    """(left_id, right_id, left_name, right_name) of rows (id, block, name): all pairs of one block that reach the ratio,
    and others that only share a rare run. Empty names are alike to nothing. ``shared`` says what common subsequence the ratio
    asks for: that of an indel ratio, or ``shared_by_edits``."""
    from regiolith.operators.graph import materialised

    left, right = (materialised(x.select("id", "block", "name").where("block is not null and name <> ''")) for x in (left, right))
    pairs = materialised(length_pairs(left, right, ratio, shared))
    a, b = with_lengths(left, pairs, "a", "b"), with_lengths(right, pairs, "b", "a")
    keyed = [by_deletion(a), by_deletion(b)]
    if pairs.where("q > 0").limit(1).count():
        often = gram_counts(a, b)
        keyed = [keyed[0].unionByName(by_grams(a, often, "a", "b")), keyed[1].unionByName(by_grams(b, often, "b", "a"))]
    on = ["block", "a", "b", "q", "key"]
    x = keyed[0].select(*on, F.col("id").alias("left_id"), F.col("name").alias("left_name"))
    y = keyed[1].select(*on, F.col("id").alias("right_id"), F.col("name").alias("right_name"))
    return x.join(y, on).select("left_id", "right_id", "left_name", "right_name").distinct()


def alike_links(df: DataFrame, ratio: float) -> DataFrame:
    """(u, v) of rows (id, block, name) whose components are those of all pairs of one block that reach the ratio.

    Equal names link to the least of them. Names that share a text of deletions are all alike to the shorter ones among
    them, so they link to the least of those: a block of any size gives as many links as it has names."""
    from regiolith.operators.graph import materialised
    from regiolith.operators.matching import indel_ratio_column

    rows = df.select("id", "block", "name").where("block is not null and name <> ''")
    first = materialised(rows.groupBy("block", "name").agg(F.min("id").alias("id")))
    equal = rows.join(first.withColumnRenamed("id", "u"), ["block", "name"]).where("id <> u").select("u", F.col("id").alias("v"))
    pairs = materialised(length_pairs(first, first, ratio).where("a <= b"))
    short, long = with_lengths(first, pairs, "a", "b"), with_lengths(first, pairs, "b", "a")
    keyed = by_deletion(short).select("block", "a", "b", "key", "id", F.lit(True).alias("short"))
    keyed = keyed.unionByName(by_deletion(long.where("a < b")).select("block", "a", "b", "key", "id", F.lit(False).alias("short")))
    centre = keyed.where("short").groupBy("block", "a", "b", "key").agg(F.min("id").alias("u"))
    near = keyed.join(centre, ["block", "a", "b", "key"]).where("id <> u").select("u", F.col("id").alias("v"))
    exact = equal.unionByName(near).distinct()
    if not pairs.where("q > 0").limit(1).count():
        return exact
    often = gram_counts(short, long)
    on = ["block", "a", "b", "q", "key"]
    x = by_grams(short, often, "a", "b").select(*on, F.col("id").alias("u"), F.col("name").alias("name_u"))
    y = by_grams(long, often, "b", "a").select(*on, F.col("id").alias("v"), F.col("name").alias("name_v"))
    rest = x.join(y, on).where((F.col("a") < F.col("b")) | (F.col("u") < F.col("v"))).select("u", "v", "name_u", "name_v").distinct()
    far = (1 - ratio / 100) * (F.length("name_u") + F.length("name_v"))  # an edit distance is at most the indel distance
    checked = rest.where(F.levenshtein("name_u", "name_v") <= far + 1e-9).where(indel_ratio_column()("name_u", "name_v") >= ratio - 1e-9)
    return exact.unionByName(checked.select("u", "v")).distinct()
