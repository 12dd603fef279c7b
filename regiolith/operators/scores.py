"""Scorecards: column expressions over businesses and over cluster aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.operators.enrich import constant_table, prefix_lookup

# Growth by code prefix, weights, points and multipliers of the scores.
GROWTH = {"484": 0.06, "493": 0.08, "3254": 0.07, "5415": 0.09, "332": 0.04, "3253": 0.05}
DEFAULT_GROWTH, MOST_GROWTH = 0.05, 0.09
WEIGHTS = {"innovation": 0.30, "market": 0.40, "competition": 0.30}
RESOURCE_WEIGHT = 0.15


def starts(code: str, *prefixes: str) -> Column:
    return F.col(code).rlike("^(?:" + "|".join(prefixes) + ")")


def clamped(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def innovation_score() -> Column:
    """Patents and awards with diminishing returns, and points of research codes."""
    patents = 40.0 * F.least(F.lit(1.0), F.log1p(F.greatest(F.col("patent_count"), F.lit(0)).cast("double")) / math.log(51))
    awards = 40.0 * F.least(F.lit(1.0), F.log1p(F.greatest(F.col("sbir_awards"), F.lit(0)).cast("double")) / math.log(11))
    research = F.when(starts("naics_code", "5417"), 20.0).when(starts("naics_code", "3254"), 15.0).when(starts("naics_code", "5415", "5112"), 10.0).otherwise(0.0)
    return clamped(patents + awards + research)


def market_potential(growth: Column, as_of: int) -> Column:
    """Growth of the code, scale by logarithms, and momentum that favours the young."""
    scale = 15.0 * F.least(F.lit(1.0), F.log1p(F.greatest(F.col("revenue_estimate"), F.lit(0.0))) / math.log1p(1e10))
    scale = scale + 15.0 * F.least(F.lit(1.0), F.log1p(F.greatest(F.col("employees"), F.lit(1)).cast("double")) / math.log1p(100_000))
    age = F.greatest(F.lit(0), F.lit(as_of) - F.col("year_established"))
    factor = F.when(age <= 5, 1.0).when(age <= 10, 2 / 3).otherwise(1 / 3)
    return clamped(40.0 * growth / MOST_GROWTH + scale + F.least(F.lit(30.0), 30.0 * factor * growth / 0.10))


def position(ratio: Column) -> Column:
    return F.when(ratio >= 5, 20.0).when(ratio >= 2, 15.0).when(ratio >= 1, 10.0).otherwise(5.0 * ratio)


def competition_score() -> Column:
    """Size against the medians of the code, innovation, and how crowded the code is."""
    def ratio(c: str, median: str) -> Column:
        return F.when(F.col(median) > 0, F.col(c) / F.col(median)).otherwise(1.0)

    patents = F.when(F.col("patent_count") > 5, 20).when(F.col("patent_count") > 0, 10 + F.col("patent_count") * 2).otherwise(0)
    awards = F.when(F.col("sbir_awards") > 0, F.least(F.lit(10), F.col("sbir_awards") * 5)).otherwise(0)
    crowd = F.when(F.col("n") < 50, 30).when(F.col("n") < 100, 20).when(F.col("n") < 200, 10).otherwise(5)
    share = F.when(F.col("n") < 50, 10).when(F.col("n") > 200, -10).otherwise(0)
    return clamped(position(ratio("employees", "median_employees")) + position(ratio("revenue_estimate", "median_revenue")) + F.least(F.lit(30), patents + awards) + crowd + share)


def regional_multiplier() -> Column:
    return (
        F.when(starts("naics_code", "3254"), 1.25).when(starts("naics_code", "112"), 1.30).when(starts("naics_code", "54"), 1.20)
        .when(starts("naics_code", "484", "493"), 1.15).when(starts("naics_code", "52"), 1.15).when(starts("naics_code", "31", "32", "33"), 1.10).otherwise(1.0)
    )


def composite(resource: Column | None = None) -> Column:
    base = sum((F.col(n) * w for n, w in (("innovation_score", WEIGHTS["innovation"]), ("market_score", WEIGHTS["market"]), ("competition_score", WEIGHTS["competition"]))), F.lit(0.0))
    return base if resource is None else base * (1 - RESOURCE_WEIGHT) + resource * RESOURCE_WEIGHT


def industry_stats(df: DataFrame) -> DataFrame:
    """(code3, n, median_employees, median_revenue): a dimension with a row for each 3-digit code."""
    return df.groupBy(F.substring("naics_code", 1, 3).alias("code3")).agg(
        F.count(F.lit(1)).alias("n"), F.median("employees").alias("median_employees"), F.median("revenue_estimate").alias("median_revenue")
    )


def scored(df: DataFrame, as_of: int, resource: Column | None = None) -> DataFrame:
    """Adds innovation, market and competition scores, the composite, and the composite with the regional multiplier."""
    grown = prefix_lookup(df, "naics_code", constant_table(df.sparkSession, GROWTH), DEFAULT_GROWTH, "growth__")
    joined = grown.withColumn("code3", F.substring("naics_code", 1, 3)).join(F.broadcast(industry_stats(df)), "code3", "left")
    out = joined.withColumn("innovation_score", innovation_score()).withColumn("market_score", market_potential(F.col("growth__"), as_of)).withColumn("competition_score", competition_score())
    out = out.withColumn("composite_score", composite(resource)).withColumn("final_score", F.col("composite_score") * regional_multiplier())
    return out.drop("growth__", "code3", "n", "median_employees", "median_revenue")


def quick_score(as_of: int) -> Column:
    """A cheap score for a first cut: logarithms of size, patents and awards, and age."""
    age = F.lit(as_of) - F.col("year_established")
    return (
        F.least(F.lit(30.0), 5 * F.log10(1 + F.col("revenue_estimate"))) + F.least(F.lit(30.0), 10 * F.log10(1 + F.col("employees")))
        + F.least(F.lit(20), F.col("patent_count") * 4) + F.least(F.lit(10), F.col("sbir_awards") * 5) + F.when(age.between(3, 20), 10).otherwise(5)
    )


def cluster_risk(members: DataFrame, as_of: int) -> DataFrame:
    """Concentration, youth, smallness and volatile industries, in points."""
    top = members.groupBy("cluster_id", F.substring("naics_code", 1, 3).alias("code")).count().groupBy("cluster_id").agg(F.max("count").alias("top"), F.count(F.lit(1)).alias("codes"))
    base = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.lit(as_of) - F.col("year_established")).alias("age"), F.count_if(F.col("employees") < 20).alias("small"),
        F.count_if(F.substring("naics_code", 1, 3).isin("484", "332")).alias("volatile"),
    )
    j = base.join(top, "cluster_id")
    risk = (
        F.when(F.col("codes") == 1, 30).when(F.col("top") / F.col("n") > 0.7, 20).otherwise(0) + F.when(F.col("age") < 3, 20).otherwise(0)
        + F.when(F.col("small") / F.col("n") > 0.7, 15).otherwise(0) + F.col("volatile") / F.col("n") * 20
    )
    return j.select("cluster_id", risk.alias("risk"))


# Pairs of 3- or 4-digit codes that go together, and their points.
SYNERGIES = [("484", "493", 30), ("332", "484", 20), ("3254", "5417", 25), ("5415", "5416", 20)]


def intra_synergy(members: DataFrame) -> DataFrame:
    """Points of code pairs in a cluster, of few counties, and of mixed sizes. Pairs are unordered."""
    codes = members.select("cluster_id", F.explode(F.array(F.substring("naics_code", 1, 3), F.substring("naics_code", 1, 4))).alias("code")).distinct()
    table = members.sparkSession.createDataFrame(SYNERGIES, "a string, b string, points int")
    a, b = codes.withColumnRenamed("code", "a"), codes.withColumnRenamed("code", "b")
    points = a.join(F.broadcast(table), "a").join(b, ["cluster_id", "b"]).groupBy("cluster_id").agg(F.sum("points").alias("points"))
    base = members.groupBy("cluster_id").agg(F.count_distinct("county").alias("counties"), F.stddev_samp("employees").alias("spread"))
    score = F.coalesce("points", F.lit(0)) + F.when(F.col("counties") <= 3, 20).otherwise(0) + F.when(F.col("spread") > 50, 15).otherwise(0)
    return base.join(points, "cluster_id", "left").select("cluster_id", score.alias("synergy"))


def success_probability(members: DataFrame, as_of: int) -> DataFrame:
    """Five weighted factors of a cluster, kept between 0.35 and 0.80."""
    g = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring("naics_code", 1, 3)).alias("codes"), F.avg(F.lit(as_of) - F.col("year_established")).alias("age"),
        F.try_divide(F.stddev_samp("revenue_estimate"), F.avg("revenue_estimate")).alias("cv"), F.percentile("employees", F.lit(0.75)).alias("upper"),
    )
    p = (
        0.30 * F.least(F.lit(1.0), F.col("upper") / 500) + 0.20 * F.least(F.lit(1.0), F.col("n") / 50) + 0.20 * F.least(F.lit(1.0), F.col("codes") / 5)
        + 0.15 * F.least(F.lit(1.0), F.col("age") / 20) + 0.15 * F.greatest(F.lit(0.0), 1 - F.coalesce("cv", F.lit(1.0)) / 2)
    )
    return g.select("cluster_id", clamped(p, 0.35, 0.80).alias("success"))


def longevity(members: DataFrame, as_of: int) -> DataFrame:
    """A 0 to 10 score of how long a cluster lasts: size, age, innovation and spread of codes."""
    g = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.lit(as_of) - F.col("year_established")).alias("age"), F.sum("patent_count").alias("patents"),
        F.count_distinct(F.substring("naics_code", 1, 3)).alias("codes"),
    )
    score = 5 + F.when(F.col("n") >= 50, 2).when(F.col("n") >= 20, 1).otherwise(0) + F.when(F.col("age") >= 15, 1).otherwise(0) + F.when(F.col("patents") >= 100, 1).otherwise(0) + F.when(F.col("codes") >= 3, 1).otherwise(-1)
    return g.select("cluster_id", F.least(F.lit(10), score).alias("longevity"))


def network_metrics(members: DataFrame) -> DataFrame:
    """Density, connections and resilience of a cluster whose members are linked within a county."""
    per = members.groupBy("cluster_id", "county").agg(F.count(F.lit(1)).alias("k"))
    g = per.groupBy("cluster_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("links"), F.max("k").alias("largest"))
    possible = F.col("n") * (F.col("n") - 1) / 2
    return g.select("cluster_id", F.col("links").cast("long").alias("links"), F.coalesce(F.try_divide("links", possible), F.lit(0.0)).alias("density"), (1 - F.col("largest") / F.col("n")).alias("resilience"))
