"""Aggregations over awards, patents, crime and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.operators.enrich import constant_table, prefix_lookup

# Multipliers and growth by code prefix.
EMPLOYMENT_MULTIPLIERS = {"484": 1.8, "493": 1.7, "3254": 2.1, "5415": 2.3, "332": 1.6, "3253": 1.9}
INDUSTRY_MULTIPLIERS = {"484": 1.8, "493": 1.7, "3254": 1.9, "5415": 1.6, "332": 1.7, "3253": 1.8}
SEVERITY = {"purchase": 3, "click": 2}


def weighted_multiplier(members: DataFrame, table: dict[str, float], default: float) -> DataFrame:
    """Revenue times the multiplier of the code, and the average multiplier, of each cluster."""
    found = prefix_lookup(members, "naics_code", constant_table(members.sparkSession, table), default, "multiplier")
    return found.groupBy("cluster_id").agg(
        F.sum(F.col("revenue_estimate") * F.col("multiplier")).alias("impact"), F.avg("multiplier").alias("multiplier")
    )


def crime_by_zip(crime: DataFrame, severity: dict[str, int] = SEVERITY, other: int = 1) -> DataFrame:
    weight = F.lit(other)
    for name, value in severity.items():
        weight = F.when(F.col("category") == name, value).otherwise(weight)
    return crime.groupBy("zip").agg(F.count(F.lit(1)).alias("incidents"), F.avg(weight).alias("severity"))


def awards_rollup(awards: DataFrame) -> DataFrame:
    """Counts, sums and companies by agency, by phase, by year and over all, in one pass."""
    return (
        awards.groupingSets([["agency"], ["phase"], ["award_year"], []], "agency", "phase", "award_year")
        .agg(F.count(F.lit(1)).alias("awards"), F.sum("amount").alias("funding"), F.count_distinct("company").alias("companies"))
        .select("agency", "phase", "award_year", "awards", "funding", "companies")
    )


def innovation_leaders(awards: DataFrame, least_awards: int, least_amount: float) -> DataFrame:
    """Companies with enough awards or funding: phases reached, agencies, last year and a score."""
    found = awards.groupBy("company").agg(
        F.count(F.lit(1)).alias("awards"), F.sum("amount").alias("funding"), F.max("award_year").alias("last_year"),
        F.bool_or(F.col("phase") == "Phase II").alias("reached_second"), F.count_distinct("agency").alias("agencies"),
    )
    score = F.least(F.lit(40.0), F.col("awards") * 2.0) + F.least(F.lit(40.0), F.col("funding") / 100_000) + F.when(F.col("reached_second"), 10).otherwise(0) + F.least(F.lit(10), F.col("agencies") * 2)
    return found.where((F.col("awards") >= least_awards) | (F.col("funding") >= least_amount)).withColumn("score", score)


def patent_portfolio(patents: DataFrame, group: str) -> DataFrame:
    """Totals, citation figures and technology spread of the patents of each group.

    Codes are exploded from both code columns; their entropy is normalised by ln 3."""
    totals = patents.groupBy(group).agg(
        F.count(F.lit(1)).alias("patents"), F.sum("citations").alias("citations"), F.avg("citations").alias("average_citations"),
        F.count_if(F.col("citations") > 10).alias("breakthroughs"), F.min("grant_year").alias("first_year"), F.max("grant_year").alias("last_year"),
    )
    codes = patents.select(group, F.explode(F.array("cpc1", "cpc2")).alias("code"))
    counted = codes.groupBy(group, "code").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    spread = counted.withColumn("p", share).groupBy(group).agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(3.0))).alias("diversity"), F.max("p").alias("top_share"))
    years = F.col("last_year") - F.col("first_year") + 1
    return totals.join(spread, group).withColumn("velocity", F.col("patents") / years).withColumn("breakthrough_ratio", F.col("breakthroughs") / F.col("patents"))


def top_groups(df: DataFrame, group: str, n: int, value: Column | None = None, name: str = "n") -> DataFrame:
    """The n largest groups by count or by the sum of a value; ties go to the least key."""
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    return df.groupBy(group).agg(total.alias(name)).orderBy(F.desc(name), group).limit(n)


def holder_statistics(counts: DataFrame, value: str) -> DataFrame:
    """One row: holders, total, share with any, average per holder, and sizes of four bands."""
    v = F.col(value)
    return counts.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(v).alias("total"), F.count_if(v > 0).alias("holders"),
        (F.count_if(v > 0) / F.count(F.lit(1))).alias("share"), F.avg(F.when(v > 0, v)).alias("per_holder"),
        F.count_if(v.between(1, 2)).alias("few"), F.count_if(v.between(3, 4)).alias("middling"), F.count_if(v >= 5).alias("many"),
    )


def data_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, distinct, least, most) of each column, from one aggregation."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        x = F.col(c)
        aggregates += [
            F.count_if(x.isNull()).alias(f"{c}__nulls"), F.count_distinct(x).alias(f"{c}__distinct"),
            F.min(x).cast("string").alias(f"{c}__least"), F.max(x).cast("string").alias(f"{c}__most"),
        ]
    row = df.agg(*aggregates)
    parts = [
        F.struct(F.lit(c).alias("column"), "rows", F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct"), F.col(f"{c}__least").alias("least"), F.col(f"{c}__most").alias("most"))
        for c in columns
    ]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def score_bands(df: DataFrame, score: str) -> DataFrame:
    band = F.when(F.col(score) >= 90, "elite").when(F.col(score) >= 70, "high").when(F.col(score) >= 50, "medium").otherwise("low")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def community_details(members: DataFrame, as_of: int) -> DataFrame:
    """Counts, averages and size classes of each community, with its three largest industries."""
    small, large = F.col("employees") < 50, F.col("employees") >= 500
    totals = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("businesses"), F.avg("employees").alias("average_employees"), F.sum("revenue_estimate").alias("revenue"),
        F.avg(F.lit(as_of) - F.col("year_established")).alias("average_age"), F.count_if(small).alias("small"),
        F.count_if(~small & ~large).alias("medium"), F.count_if(large).alias("large"),
    )
    counts = members.groupBy("cluster_id", F.substring("naics_code", 1, 3).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "code")
    top = counts.withColumn("nth", F.row_number().over(w)).where("nth <= 3")
    joined = top.groupBy("cluster_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("nth", "code"))), lambda x: x["code"])).alias("top_industries"))
    return totals.join(joined, "cluster_id")


def county_impact(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """GDP, jobs and return of clusters (cluster_id, gdp, jobs, roi) dealt to counties by their share of the members.

    ``class`` is the third of the GDP and the third of the member-weighted return; counties are few."""
    per = members.groupBy("cluster_id", "county").agg(F.count(F.lit(1)).alias("k"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(sizes, "cluster_id").join(clusters, "cluster_id")
    share = F.col("k") / F.col("n")
    g = j.groupBy("county").agg(
        F.round(F.sum(F.col("gdp") * F.col("k") / F.col("n")), 2).alias("gdp"), F.round(F.sum(F.col("jobs") * share), 6).alias("jobs"), F.sum("k").alias("members"),
        F.round(F.sum(F.col("roi") * F.col("k")) / F.sum("k"), 6).alias("roi"),
    )
    total = F.count(F.lit(1)).over(Window.partitionBy())
    third = lambda c: F.ceil(F.row_number().over(Window.orderBy(c, "county")) * 3 / total).cast("int").cast("string")
    tier = F.when(F.col("gdp") >= 1e9, "high").when(F.col("gdp") >= 1e8, "medium").otherwise("low")
    return g.select("county", "gdp", "jobs", "members", "roi", F.concat_ws("-", third("gdp"), third("roi")).alias("class"), tier.alias("tier"))
