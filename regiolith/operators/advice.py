"""Recommendations, findings and conditions of clusters, from rules that are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "audience string, priority int, type string, metric string, sign string, bound double, text string"

# Who is told what when which metric of a cluster (of a type, or any) is beyond which bound.
RULES = [
    ("entrepreneurs", 2, "logistics", "jobs", ">=", 0.0, "Start delivery services for the last mile"),
    ("entrepreneurs", 3, "logistics", "critical_mass", ">=", 40.0, "Offer cooled transport to food and drug makers"),
    ("entrepreneurs", 2, "technology", "jobs", ">=", 0.0, "Offer security services to banks and hospitals"),
    ("entrepreneurs", 3, "technology", "counties", ">=", 3.0, "Build sensors and software for farms"),
    ("entrepreneurs", 2, "biosciences", "innovation", ">", 0.0, "Build software that manages clinical trials"),
    ("entrepreneurs", 3, "manufacturing", "small_share", ">=", 0.3, "Advise small works on how to scale"),
    ("investors", 1, None, "annual_return", ">=", 60.0, "Invest early: the yearly return on development is high"),
    ("investors", 2, None, "risk", "<", 30.0, "Low risk: suited to long holding"),
    ("investors", 2, None, "risk", ">=", 60.0, "High risk: ask for a larger share"),
    ("investors", 1, None, "gdp_rank", "<=", 1.0, "Put this cluster first in the portfolio"),
    ("universities", 2, "logistics", "jobs", ">", 0.0, "Research supply chains with learning methods"),
    ("universities", 2, "biosciences", "awards", ">", 0.0, "Research drugs with the winners of grants"),
    ("universities", 2, "technology", "patents", ">=", 50.0, "Research computing with the holders of patents"),
    ("universities", 3, "manufacturing", "patents", "<", 50.0, "Bring research on materials to the works"),
    ("policymakers", 1, "logistics", "counties", ">=", 2.0, "Join the rail of the counties"),
    ("policymakers", 2, "technology", "small_share", ">=", 0.2, "Extend broadband to young firms"),
    ("policymakers", 2, "biosciences", "critical_mass", "<", 60.0, "Build shared laboratories"),
    ("training", 1, None, "jobs", ">=", 5000.0, "Train workers: more jobs than the region can fill"),
    ("training", 2, None, "small_share", ">=", 0.5, "Share apprentices among small firms"),
    ("mitigation", 1, None, "risk", ">=", 40.0, "Widen the mix of industries to lower the risk"),
    ("mitigation", 2, None, "synergy", "<", 20.0, "Bring suppliers and buyers together"),
    ("market", 1, None, "jobs_rank", "<=", 1.0, "Direct resources to the cluster with the most jobs"),
    ("market", 2, None, "revenue_rank", "<=", 2.0, "Defend the share of the largest markets"),
    ("patents", 2, None, "patents", "<", 100.0, "Fund research and the filing of patents"),
    ("patents", 1, None, "patents_rank", "<=", 2.0, "License the patents of the leading innovators"),
    ("partnerships", 2, None, "awards", ">=", 10.0, "Pair the winners of grants with larger firms"),
    ("investment", 1, None, "critical_mass", ">=", 60.0, "Support growth across the cluster"),
    ("investment", 2, None, "critical_mass", "<", 40.0, "Recruit anchor firms before anything else"),
]
#: The first findings of a kind that a report names.
QUOTAS = {"opportunity": 2, "threat": 1}
# What counts as an opportunity or a threat, and how much a unit beyond the bound weighs.
FINDINGS = [
    ("opportunity", "innovation", ">", 100.0, 0.010, "new products"), ("opportunity", "jobs", ">", 1000.0, 0.002, "a large workforce"),
    ("opportunity", "synergy", ">", 10.0, 0.200, "trade within the cluster"), ("opportunity", "critical_mass", ">", 30.0, 0.150, "a full ecosystem"),
    ("threat", "risk", ">", 10.0, 0.300, "few industries or young firms"), ("threat", "small_share", ">", 0.1, 9.000, "many small firms"),
    ("threat", "critical_mass", "<", 60.0, 0.050, "gaps in the ecosystem"),
]


def facts(clusters: DataFrame, metrics: list[str], ranked: list[str] = []) -> DataFrame:
    """(cluster_id, type, metric, value) of clusters (cluster_id, type, metrics...), with the place of each of ``ranked``."""
    places = {f"{c}_rank": F.row_number().over(Window.orderBy(F.desc(c), "cluster_id")) for c in ranked}  # clusters are few
    wide = clusters.withColumns(places) if places else clusters
    columns = [*metrics, *places]
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return wide.select("cluster_id", "type", F.explode(values).alias("x")).select("cluster_id", "type", "x.metric", "x.value")


def holds(value: Column, sign: Column, bound: Column) -> Column:
    return F.when(sign == ">=", value >= bound).when(sign == ">", value > bound).when(sign == "<=", value <= bound).when(sign == "<", value < bound).otherwise(False)


def recommendations(known: DataFrame, rules: DataFrame) -> DataFrame:
    """(cluster_id, audience, priority, recommendation, metric, value): the rules (RULE) that facts fulfil.

    A rule without a type holds for clusters of any type; a fact without a value fulfils none. Rules are a small table."""
    joined = known.join(F.broadcast(rules.withColumnRenamed("type", "rule_type")), "metric").where("rule_type is null or rule_type = type")
    met = joined.where(holds(F.col("value"), F.col("sign"), F.col("bound")))
    return met.select("cluster_id", "audience", "priority", F.col("text").alias("recommendation"), "metric", "value")


def key_findings(known: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """(cluster_id, kind, place, finding, strength): the strongest opportunities and threats of each cluster."""
    spark = known.sparkSession
    table = spark.createDataFrame(FINDINGS, "kind string, metric string, sign string, bound double, unit double, finding string")
    met = known.join(F.broadcast(table), "metric").where(holds(F.col("value"), F.col("sign"), F.col("bound")))
    rated = met.withColumn("strength", F.abs(F.col("value") - F.col("bound")) * F.col("unit"))
    w = Window.partitionBy("cluster_id", "kind").orderBy(F.desc("strength"), "finding")  # a few findings a cluster
    most = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in quotas.items()], F.lit(0))
    return rated.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("cluster_id", "kind", "place", "finding", "strength")


def emerging_classes(patents: DataFrame, now: int, years: int = 2, top: int = 10, smooth: float = 5.0) -> DataFrame:
    """(cpc1, recent, earlier, growth, place): classes whose counts grew most from one window of years to the next.

    ``patents`` has (cpc1, grant_year). Both counts gain ``smooth``, so that few patents are no trend."""
    year = F.col("grant_year")
    counts = patents.where(F.col("cpc1").isNotNull()).groupBy("cpc1").agg(
        F.count_if((year > now - years) & (year <= now)).alias("recent"), F.count_if((year > now - 2 * years) & (year <= now - years)).alias("earlier")
    )
    grown = counts.where("recent + earlier > 0").withColumn("growth", (F.col("recent") + smooth) / (F.col("earlier") + smooth))
    first = grown.orderBy(F.desc("growth"), F.desc("recent"), "cpc1").limit(top)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("growth"), F.desc("recent"), "cpc1")))  # ``top`` rows


def as_of_values(readings: DataFrame, dates: list[str]) -> DataFrame:
    """(indicator, as_of, value, before): the last reading (indicator, ts, id, value) up to each date, and that up to the date before.

    Each reading counts for the first date that is not before it; the last one of each indicator and date is kept in one
    aggregate, and only this small table is filled forward."""
    ends = sorted(dates)
    until = F.coalesce(*[F.when(F.col("ts") <= F.to_timestamp(F.lit(d)), d) for d in ends])
    last = readings.withColumn("as_of", until).where("as_of is not null and value is not null").groupBy("indicator", "as_of").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
    spark = readings.sparkSession
    every = last.select("indicator").distinct().crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in ends], "as_of string")))
    w = Window.partitionBy("indicator").orderBy("as_of")
    filled = every.join(last, ["indicator", "as_of"], "left").withColumn("value", F.last("value", ignorenulls=True).over(w))
    return filled.withColumn("before", F.lag("value").over(w))


# Indicators on which a type depends, and the part of its pressure that each makes.
DEPENDS = [
    ("logistics", "click", 0.6), ("logistics", "view", 0.4), ("technology", "signup", 0.7), ("technology", "view", 0.3),
    ("biosciences", "purchase", 1.0), ("manufacturing", "purchase", 0.5), ("manufacturing", "click", 0.5),
]


def market_context(readings: DataFrame, dates: list[str], types: DataFrame, depends: list[tuple[str, str, float]] = DEPENDS, high: float = 50.0, step: float = 0.05) -> DataFrame:
    """A row for each type and date: pressure of the indicators it depends on, how many rise and fall, and the flags.

    ``types`` has (type, market_score, risk). An indicator rises or falls if it has moved by more than ``step`` of its value
    at the date before. The pressure is the weighted mean of what is known; the flags are those that scores of longevity and
    risk ask for: volatile (pressure over ``high``), trend, and whether it is an election year. The outlook is the market
    score less the risk, ten points less where it is volatile."""
    spark = readings.sparkSession
    values = as_of_values(readings, dates)
    move = (F.col("value") - F.col("before")) / F.abs("before")
    table = spark.createDataFrame(depends, "type string, indicator string, part double")
    known = values.join(F.broadcast(table), "indicator").groupBy("type", "as_of").agg(
        F.try_divide(F.sum(F.col("value") * F.col("part")), F.sum(F.when(F.col("value").isNotNull(), F.col("part")))).alias("pressure"),
        F.count_if(move > step).alias("rising"), F.count_if(move < -step).alias("falling"),
    )
    every = types.crossJoin(F.broadcast(spark.createDataFrame([(d,) for d in dates], "as_of string")))
    j = every.join(known, ["type", "as_of"], "left")
    volatile = F.coalesce(F.col("pressure") > high, F.lit(False))
    rising, falling = F.coalesce("rising", F.lit(0)), F.coalesce("falling", F.lit(0))
    return j.select(
        "type", "as_of", "market_score", "risk", "pressure", rising.alias("rising"), falling.alias("falling"), volatile.alias("volatile"),
        F.when(rising > falling, "rising").when(rising < falling, "falling").otherwise("stable").alias("trend"), (F.year("as_of") % 4 == 0).alias("election_year"),
        (F.col("market_score") - F.col("risk") - F.when(volatile, 10.0).otherwise(0.0)).alias("outlook"),
    )
