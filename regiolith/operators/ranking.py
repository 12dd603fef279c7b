"""Ranking of businesses: revenue, filters, sample, scores, order and a threshold that follows the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.operators.reports import estimated_revenue, industry_filters
from regiolith.operators.scores import scored

# Levels of the percentiles between which a break is looked for; part that is left out and businesses that are needed, by mode.
LEVELS = (99, 95, 90, 80, 70, 60, 50, 40, 30, 20, 10, 5, 1)
MODES = {"quick": (0.30, 100), "full": (0.45, 500)}
QUICK_BELOW = 1000
OUTPUT_EACH, JOBS_EACH = 2.3, 1.6


def filled_revenue(df: DataFrame) -> DataFrame:
    """Missing and zero revenue from employees and industry."""
    own = F.coalesce("revenue_estimate", F.lit(0.0))
    return df.withColumn("revenue_estimate", F.when(own == 0, estimated_revenue(F.coalesce("employees", F.lit(0)), F.col("naics_code"))).otherwise(own))


def stratified(df: DataFrame, size: int, strata: list[Column], order: list[Column]) -> DataFrame:
    """The first rows of each stratum, as many of ``size`` as its share; all rows if there are no more than that."""
    named = df.withColumn("stratum__", F.concat_ws("\u0001", *strata))
    counts = named.groupBy("stratum__").agg(F.count(F.lit(1)).alias("n__"))
    total = counts.agg(F.sum("n__").alias("total__"))  # one row
    w = Window.partitionBy("stratum__").orderBy(*order)
    placed = named.join(counts, "stratum__").crossJoin(F.broadcast(total)).withColumn("nth__", F.row_number().over(w))
    return placed.where((F.col("total__") <= size) | (F.col("nth__") <= F.ceil(F.lit(float(size)) * F.col("n__") / F.col("total__")))).select(df.columns)


def threshold_part(rows: DataFrame, score: str, mode: str | None = None, targets: tuple[float, float] | None = None) -> DataFrame:
    """One row (part, best, n): the part of the best score that a score may lack.

    The part of the mode gives way to targets of output and jobs that need more businesses, is averaged with the widest gap
    between percentiles where that is stricter, is widened until the businesses that are needed pass, and stays in 0.05 to 0.70."""
    levels = F.percentile(score, F.array(*[F.lit(k / 100) for k in LEVELS])).alias("levels")
    s = rows.agg(levels, F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.avg("revenue_estimate").alias("revenue"), F.avg("employees").alias("employees"))
    quick = F.col("n") < QUICK_BELOW if mode is None else F.lit(mode == "quick")
    base = F.when(quick, MODES["quick"][0]).otherwise(MODES["full"][0])
    needed = F.when(quick, MODES["quick"][1]).otherwise(MODES["full"][1])
    if targets:
        need = 1.5 * F.greatest(F.lit(float(targets[0])) / (F.col("revenue") * OUTPUT_EACH), F.lit(float(targets[1])) / (F.col("employees") * JOBS_EACH)) / F.col("n")
        base = F.when(need > 1 - base, F.greatest(F.lit(0.20), 1 - need * 1.2)).otherwise(base)
    gaps = F.array(*[F.struct(F.round(F.col("levels")[i] - F.col("levels")[i + 1], 9).alias("gap"), F.lit(k).alias("level")) for i, k in enumerate(LEVELS[:-1])])
    natural = (100 - F.array_max(gaps)["level"]) / 100
    s = s.withColumn("base", base).withColumn("natural", natural).withColumn("needed", needed.cast("double"))
    part = F.when(F.col("natural") < F.col("base"), (F.col("base") + F.col("natural")) / 2).otherwise(F.col("base"))
    share = F.col("needed") / F.col("n")
    widened = F.when(share < 0.95, 1 - share * 1.1).otherwise(0.05)
    final = F.when(F.floor(F.col("n") * (1 - part) + 1e-9) < F.col("needed"), widened).otherwise(part)
    return s.select(F.greatest(F.lit(0.05), F.least(F.lit(0.70), final)).alias("part"), "best", "n")


def rank_businesses(df: DataFrame, as_of: int, sample: int | None = None, mode: str | None = None, targets: tuple[float, float] | None = None) -> DataFrame:
    """Businesses that pass their industry's filters, with scores, place and whether they pass the threshold.

    Places go by the final score, ties to the least id; they are counted by range partitions, so no task sorts the table.
    Statistics of industries are those of the businesses that are ranked."""
    kept = industry_filters(filled_revenue(df)).where("reject_reason is null").drop("reject_reason", "type")
    if sample is not None:
        kept = stratified(kept, sample, [F.col("county"), F.substring("naics_code", 1, 3)], [F.desc("revenue_estimate"), F.asc("business_id")])
    from regiolith.operators.graph import materialised

    rows = materialised(scored(kept, as_of).withColumn("score__", F.round("final_score", 6)))
    part = threshold_part(rows, "score__", mode, targets)
    order = [F.desc("score__"), F.asc("business_id")]
    cut = materialised(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part__", F.spark_partition_id()).withColumn("row__", F.monotonically_increasing_id()))
    sizes = cut.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"), F.min("row__").alias("first__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = sizes.select("part__", (F.coalesce(F.sum("n__").over(before), F.lit(0)) - F.col("first__")).alias("shift__"))
    placed = cut.join(F.broadcast(shifts), "part__").withColumn("place", F.col("row__") + F.col("shift__") + 1)
    judged = placed.crossJoin(F.broadcast(part)).withColumn("passes", F.col("score__") >= F.col("best") * (1 - F.col("part")))
    return judged.select(*df.columns, "innovation_score", "market_score", "competition_score", F.col("score__").alias("final_score"), "place", "passes", F.col("part").alias("threshold_part"))
