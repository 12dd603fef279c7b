"""The end-to-end flow over the business view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.operators import cleaning, clusters, communities, projections, scores
from regiolith.operators.graph import materialised
from regiolith.plans.views import view

AS_OF = 2024


def ranked_communities(spark: SparkSession, sf_dir: str, smallest: int = 10) -> DataFrame:
    """Businesses, cleaned and scored, in natural communities, ranked by five-year impact."""
    b = cleaning.winsorized(view(spark, sf_dir, "business"), "revenue_estimate", 10_000.0, 1e9)
    b = materialised(cleaning.keep_best(b, ["name", "county"], [F.desc("revenue_estimate"), F.asc("business_id")]))
    good = materialised(cleaning.near_top(scores.scored(b, AS_OF), "final_score", 0.9))
    found = communities.natural_communities(good, smallest)
    impact = projections.economic_impact(good.join(found.withColumnRenamed("community", "cluster_id"), "business_id"))
    return clusters.ranked(impact, [F.desc("gdp_impact"), F.asc("cluster_id")])
