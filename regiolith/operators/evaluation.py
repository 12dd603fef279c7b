"""The six objectives of a cluster: output, innovation, jobs, synergy, risk and critical mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolith.operators.enrich import constant_table, prefix_lookup
from regiolith.operators.rollups import EMPLOYMENT_MULTIPLIERS

# Output of an industry for a unit of revenue, how much faster than others it grows, and the growth rates.
OUTPUT = {
    "484": 1.82, "493": 1.95, "488": 1.89, "332": 2.16, "333": 2.23, "334": 1.95, "335": 2.08, "336": 2.34, "3254": 2.45, "3391": 2.12,
    "5417": 1.78, "5112": 1.92, "5415": 2.05, "5182": 1.86, "5416": 1.71, "5413": 1.68, "5411": 1.64,
}
OTHER_OUTPUT, OTHER_JOBS = 1.75, 1.7
FASTER = {"511": 1.5, "518": 1.4, "493": 1.2}
GROWTH, LEAST_GROWTH, MOST_GROWTH, JOB_PART = 0.05, 0.03, 0.15, 0.8
#: Innovation where members have no score, on a scale to 100.
USUAL_INNOVATION = 50.0


def objectives(members: DataFrame, success: DataFrame, synergy: DataFrame, risk: DataFrame, mass: DataFrame, years: int = 5, network: bool = True) -> DataFrame:
    """(cluster_id, gdp, innovation, jobs, synergy, risk, critical_mass) of clusters of members.

    The other frames have (cluster_id, value). Output by industry grows with compound interest, at a rate by the commonest
    industry (ties to the least code) and by innovation, gains from the cluster, and counts with its chance of success; jobs
    grow somewhat slower, and only new ones have jobs of suppliers in their train. Without ``network`` the gain is halved."""
    spark = members.sparkSession
    coded = prefix_lookup(members, "naics_code", constant_table(spark, OUTPUT), OTHER_OUTPUT, "output")
    coded = coded.withColumn("job_multiplier", F.coalesce(*[F.when(F.substring("naics_code", 1, 3) == k, v) for k, v in EMPLOYMENT_MULTIPLIERS.items()], F.lit(OTHER_JOBS)))
    score = F.avg("innovation_score") if "innovation_score" in members.columns else F.lit(USUAL_INNOVATION)
    g = coded.groupBy("cluster_id").agg(
        F.sum(F.col("revenue_estimate") * F.col("output")).alias("base"), F.sum(F.col("patent_count") * 10 + F.col("sbir_awards") * 20).alias("innovation"),
        F.sum("employees").alias("direct"), F.avg("job_multiplier").alias("follow"), F.coalesce(score, F.lit(USUAL_INNOVATION)).alias("level"),
    )
    code = F.substring("naics_code", 1, 3)
    counts = members.groupBy("cluster_id", code.alias("code")).count()
    first = Window.partitionBy("cluster_id").orderBy(F.desc("count"), "code")
    top = counts.withColumn("nth__", F.row_number().over(first)).where("nth__ = 1").select("cluster_id", "code")
    faster = F.coalesce(*[F.when(F.col("code") == k, v) for k, v in FASTER.items()], F.lit(1.0))
    rate = F.least(F.lit(MOST_GROWTH), F.greatest(F.lit(LEAST_GROWTH), GROWTH * faster * (1 + (F.col("level") - 50) / 100)))
    gain = (0.10 + F.col("level") / 100 * 0.20) * (1.0 if network else 0.5)
    out = g.join(top, "cluster_id").withColumn("rate", rate)
    for frame, name in ((success, "success"), (synergy, "synergy"), (risk, "risk"), (mass, "critical_mass")):
        value = next(c for c in frame.columns if c != "cluster_id")
        out = out.join(frame.select("cluster_id", F.col(value).alias(name)), "cluster_id")
    new = F.col("direct") * (F.pow(1 + F.col("rate") * JOB_PART, F.lit(years)) - 1)
    return out.select(
        "cluster_id", (F.col("base") * F.pow(1 + F.col("rate"), F.lit(years)) * (1 + gain) * F.col("success")).alias("gdp"), "innovation",
        F.floor(F.col("direct") + new * F.col("follow") + 1e-6).cast("long").alias("jobs"), "synergy", "risk", "critical_mass",
    )
