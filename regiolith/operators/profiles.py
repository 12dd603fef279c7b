"""Names and types of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiolith.operators.clusters import shares


def dominant_place(members: DataFrame, metro: str = "metro") -> DataFrame:
    """(cluster_id, place): one county with most members, two with a large second, or the metro area."""
    w = Window.partitionBy("cluster_id")
    ranked = shares(members, "cluster_id", F.col("county")).withColumn("i", F.row_number().over(w.orderBy(F.desc("n"), "key"))).withColumn("k", F.count(F.lit(1)).over(w))
    first = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    flat = ranked.groupBy("cluster_id").agg(first("key", 1).alias("a"), first("share", 1).alias("p"), first("key", 2).alias("b"), first("share", 2).alias("q"), F.max("k").alias("k"))
    place = F.when(F.col("p") > 0.6, F.col("a")).when(F.col("q") > 0.25, F.concat_ws("-", "a", "b")).when(F.col("k") > 3, metro).otherwise(F.col("a"))
    return flat.select("cluster_id", place.alias("place"))
