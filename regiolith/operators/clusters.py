"""Operators on clusters and their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiolith.functions import text as T
from regiolith.operators.geo import KILOMETRES, haversine, near_pairs
from regiolith.operators.graph import connected_components
from regiolith.operators.matching import sequence_ratio_column

#: Centres of clusters with names alike are this near, in km.
SAME_NAME_KM = 5.0


def member_jaccard(members: DataFrame, cluster: str, key: str) -> DataFrame:
    """(a, b, shared, jaccard) of pairs of clusters with a member in common; other pairs are never made."""
    m = members.select(F.col(cluster).alias("cluster"), F.col(key).alias("member")).distinct()
    sizes = m.groupBy("cluster").count()
    x, y = m.withColumnsRenamed({"cluster": "a"}), m.withColumnsRenamed({"cluster": "b"})
    shared = x.join(y, "member").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = sizes.select(F.col("cluster").alias("a"), F.col("count").alias("na")), sizes.select(F.col("cluster").alias("b"), F.col("count").alias("nb"))
    return shared.join(na, "a").join(nb, "b").select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def consolidation_links(members: DataFrame, clusters: DataFrame, strict: float = 0.45, loose: float = 0.28, near: float = 10.0) -> DataFrame:
    """(u, v) of clusters that are one: of a type and alike in members, or alike and near; of names alike and very near; or
    almost the same members at almost the same place.

    ``clusters`` has (cluster_id, type, name). Only pairs with a common member or near centres are made; distances in km."""
    overlaps = member_jaccard(members, "cluster_id", "business_id").select("a", "b", "jaccard")
    centres = members.where("latitude is not null and longitude is not null").groupBy("cluster_id").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    close = near_pairs(centres.withColumnRenamed("cluster_id", "id"), SAME_NAME_KM / 1.6).where("a < b").select("a", "b", F.lit(0.0).alias("jaccard"))
    pairs = overlaps.unionByName(close).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    facts = clusters.select("cluster_id", "type", T.key_name(F.col("name")).alias("name")).join(centres, "cluster_id", "left")
    x, y = (facts.select([F.col(c).alias(side if c == "cluster_id" else f"{c}_{side}") for c in facts.columns]) for side in "ab")
    km = haversine(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"), KILOMETRES)
    both = pairs.join(x, "a").join(y, "b").withColumn("km", km)
    j = F.col("jaccard")
    alike = (F.col("type_a") == F.col("type_b")) & ((j >= strict) | ((F.col("km") < near) & (j >= loose)))
    same = (j >= 0.7) & (F.col("km") < 3.0)
    named = both.where((F.col("km") < SAME_NAME_KM) & (F.col("name_a") != "") & (F.col("name_b") != "")).where(sequence_ratio_column()("name_a", "name_b") >= 0.9)
    return both.where(alike | same).unionByName(named).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def consolidate(members: DataFrame, clusters: DataFrame, as_of: int) -> DataFrame:
    """One row for each group of linked clusters (cluster_id, type, name, score), under its least id: members are united,
    totals are computed anew, names are joined, the score is the highest one."""
    groups = connected_components(consolidation_links(members, clusters)).withColumnsRenamed({"node": "cluster_id", "component": "merged_id"})
    placed = clusters.join(groups, "cluster_id", "left").withColumn("merged_id", F.coalesce("merged_id", "cluster_id"))
    united = members.join(placed.select("cluster_id", "merged_id"), "cluster_id").groupBy("merged_id", "business_id").agg(
        F.max("employees").alias("employees"), F.max("revenue_estimate").alias("revenue"), F.max("year_established").alias("year")
    )
    totals = united.groupBy("merged_id").agg(
        F.count(F.lit(1)).alias("businesses"), F.sum("employees").alias("employees"), F.sum("revenue").alias("revenue"), F.avg(F.greatest(F.lit(0), F.lit(as_of) - F.col("year"))).alias("average_age")
    )
    named = placed.groupBy("merged_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.min_by("type", "cluster_id").alias("type"), F.array_join(F.array_sort(F.collect_set("name")), " + ").alias("name"), F.max("score").alias("score")
    )
    return named.join(totals, "merged_id", "left")


def metrics(members: DataFrame, as_of: int) -> DataFrame:
    """Sums, averages and the innovation score of each cluster."""
    return members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("businesses"),
        F.sum("employees").alias("employees"),
        F.sum("revenue_estimate").alias("revenue"),
        F.avg(F.lit(as_of) - F.col("year_established")).alias("average_age"),
        F.sum(F.col("patent_count") * 10 + F.col("sbir_awards") * 20).alias("innovation"),
        F.count_distinct(F.substring("naics_code", 1, 3)).alias("industries"),
        F.count_distinct("county").alias("counties"),
    )


def shares(members: DataFrame, group: str, dimension: Column) -> DataFrame:
    """(group, key, n, share) of each value of a dimension within its group."""
    counts = members.groupBy(group, dimension.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def hhi(members: DataFrame, group: str, dimension: Column) -> DataFrame:
    """Concentration: the sum of squared shares."""
    return shares(members, group, dimension).groupBy(group).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"))


def shannon(members: DataFrame, group: str, dimension: Column) -> DataFrame:
    """Entropy of the shares, divided by its most for as many values; 0 for a single value."""
    found = shares(members, group, dimension).groupBy(group).agg((-F.sum(F.col("share") * F.log("share"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return found.select(group, F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k").cast("double"))).otherwise(0.0).alias("evenness"))


def gini(df: DataFrame, group: str, value: str) -> DataFrame:
    """Inequality of positive values within a group, from ranks."""
    w = Window.partitionBy(group)
    ranked = (
        df.where(F.col(value) > 0)
        .withColumn("rank__", F.row_number().over(w.orderBy(value)))
        .withColumn("n__", F.count(F.lit(1)).over(w))
    )
    weighted = F.sum((2 * F.col("rank__") - F.col("n__") - 1) * F.col(value))
    return ranked.groupBy(group).agg((weighted / (F.max("n__") * F.sum(value))).alias("gini"))


def top_share(members: DataFrame, group: str, dimension: Column) -> DataFrame:
    """(group, top, share) of the most frequent value; ties go to the least value."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), "key")
    ranked = shares(members, group, dimension).withColumn("nth__", F.row_number().over(w)).where("nth__ = 1")
    return ranked.select(group, F.col("key").alias("top"), "share")


def top_members(members: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n members of each group, with their place."""
    w = Window.partitionBy(group).orderBy(*order)
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Places over a whole table of clusters, which are few: the window has one partition."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
