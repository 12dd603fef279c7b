"""Cleaning and filtering of businesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winsorized(df: DataFrame, column: str, least: float, most: float, whole: bool = False) -> DataFrame:
    """Clips a column to 1.5 interquartile ranges around its quartiles, within hard bounds.

    Quartiles are exact and linearly interpolated; they are one row, joined back by broadcast."""
    q = df.agg(F.percentile(F.col(column).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    step = 1.5 * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
    low, high = F.get("q", F.lit(0)) - step, F.get("q", F.lit(1)) + step
    if whole:
        low, high = low.cast("long"), high.cast("long")
    bounds = q.select(F.greatest(F.lit(least), low).alias("low__"), F.least(F.lit(most), high).alias("high__"))
    kind = df.schema[column].dataType
    clipped = F.least(F.greatest(F.col(column), F.col("low__")), F.col("high__")).cast(kind)
    return df.crossJoin(F.broadcast(bounds)).withColumn(column, clipped).drop("low__", "high__")


def fixed_outlier_ratio(df: DataFrame, impossible: float = 10e6, suspicious: float = 5e6, each: float = 2e6) -> DataFrame:
    """Revenue beyond an impossible value per employee becomes ``each`` per employee; suspicious values are flagged."""
    ratio = F.try_divide(F.col("revenue_estimate"), F.col("employees"))
    return df.withColumn("suspicious", F.coalesce(ratio > suspicious, F.lit(False))).withColumn(
        "revenue_estimate", F.when(ratio > impossible, F.col("employees") * each).otherwise(F.col("revenue_estimate"))
    )


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; end the order with an id to make it definite."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")


def reject_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds the name of the first rule that a row fails; null for rows that pass. A null test counts as failed."""
    chain = F.lit(None).cast("string")
    for name, passes in reversed(rules):
        chain = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(chain)
    return df.withColumn("reject_reason", chain)


def stage_counts(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(stage, name, rejected, remaining) after each rule, from one aggregation."""
    judged = reject_reasons(df, rules)
    sums = judged.agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("reject_reason") == n).alias(f"r{i}") for i, (n, _) in enumerate(rules)]
    )
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("name"), F.col(f"r{i}").alias("rejected")) for i, (n, _) in enumerate(rules)])
    long = sums.select("all", F.explode(rows).alias("x")).select("all", "x.*")
    w = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as rules
    return long.select("stage", "name", "rejected", (F.col("all") - F.sum("rejected").over(w)).alias("remaining"))


def near_top(df: DataFrame, score: str, tolerance: float, group: list[str] | None = None) -> DataFrame:
    """Rows within a share of the best score, of all rows or of a group."""
    if group:
        best = df.groupBy(*group).agg(F.max(score).alias("best__"))
        joined = df.join(best, group)
    else:
        joined = df.crossJoin(F.broadcast(df.agg(F.max(score).alias("best__"))))
    return joined.where(F.col(score) >= F.col("best__") * (1 - tolerance)).drop("best__")


def with_prefixes(df: DataFrame, code: str, prefixes: list[str]) -> DataFrame:
    """Rows whose code starts with one of the prefixes."""
    return df.where(F.col(code).rlike("^(?:" + "|".join(prefixes) + ")"))


def balanced(df: DataFrame, code: str, caps: dict[str, int], order: list[Column]) -> DataFrame:
    """Keeps at most a number of rows of each listed code prefix, best first, and all other rows."""
    group = F.coalesce(*[F.when(F.col(code).startswith(p), F.lit(p)) for p in caps])
    cap = F.coalesce(*[F.when(F.col("group__") == p, F.lit(n)) for p, n in caps.items()])
    w = Window.partitionBy("group__").orderBy(*order)
    marked = df.withColumn("group__", group)
    rest = marked.where("group__ is null")
    kept = marked.where("group__ is not null").withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= cap).drop("nth__")
    return kept.unionByName(rest).drop("group__")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A reproducible sample of exactly n rows, by a hash of the key and the seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)
