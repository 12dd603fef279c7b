"""Exports: tables with a sample and a description, lines for people, documents for programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_enriched(df: DataFrame, folder: str, created: str, order: list[str], added: list[str], sample: int = 1000) -> None:
    """Writes the table as Parquet, its first rows by ``order`` as CSV, and one row about it as JSON.

    The row has the time given, the number of rows, the columns that were added and the share of rows that have any of them."""
    df.write.mode("overwrite").parquet(f"{folder}/data")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/data")
    written.orderBy(*order).limit(sample).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/sample")
    some = F.lit(False)
    for c in added:
        some = some | F.col(c).isNotNull()
    about = written.agg(F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg(some.cast("double")), F.lit(0.0)), 6).alias("enhancement_rate"))
    about = about.select(F.lit(created).alias("created_at"), "total", F.array(*map(F.lit, added)).cast("array<string>").alias("features_added"), "enhancement_rate", F.array(*map(F.lit, df.columns)).alias("columns"))
    about.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def cluster_lines(clusters: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """(cluster_id, at, line): a heading, a line with amounts, and one for each of the largest members, in order.

    Revenues are summed in whole cents, so that a sum of half a dollar does not turn on the order of its rows; half dollars go
    to the even one. ``clusters`` has (cluster_id, name, type, score), ``members`` (cluster_id, business_id, name, employees, revenue_estimate)."""
    from pyspark.sql import Window

    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    g = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("employees").alias("jobs"), F.sum(F.col("revenue_estimate").cast("decimal(18,2)")).alias("revenue"))
    j = clusters.join(g, "cluster_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    head = j.select("cluster_id", F.lit(0).alias("at"), F.concat("name", F.lit(" ("), "type", F.lit("), score "), F.format_number("score", 1)).alias("line"))
    amounts = F.concat(zero(F.col("n")).cast("string"), F.lit(" businesses, "), F.format_number(zero(F.col("jobs")), 0), F.lit(" employees, revenue "), money(zero(F.col("revenue"))))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("revenue_estimate"), "business_id")
    top = members.withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= most).join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    lines = top.select("cluster_id", (F.col("nth__") + 1).alias("at"), F.concat(F.col("nth__").cast("string"), F.lit(". "), "name", F.lit(", "), F.format_number("employees", 0), F.lit(" employees, "), money(F.col("revenue_estimate"))).alias("line"))
    return head.unionByName(j.select("cluster_id", F.lit(1).alias("at"), amounts.alias("line"))).unionByName(lines)


def cluster_documents(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, document): one JSON document a cluster, its members nested in order of their ids.

    A document holds a cluster whole, so a cluster of very many members makes one long row."""
    one = F.struct("business_id", "name", "county", "employees", F.round("revenue_estimate", 2).alias("revenue"))
    g = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(one)).alias("members"), F.count(F.lit(1)).alias("n"), F.sum("employees").alias("jobs"))
    j = clusters.join(g, "cluster_id", "left")
    metrics = F.struct(F.coalesce("n", F.lit(0)).alias("businesses"), F.coalesce("jobs", F.lit(0)).alias("employees"), F.round("score", 4).alias("score"))
    return j.select("cluster_id", F.to_json(F.struct("cluster_id", "name", "type", metrics.alias("metrics"), "members")).alias("document"))
