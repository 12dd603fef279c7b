"""Queries for readers and writers: files are landed from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regiolith.plans.registry import query
from regiolith.plans.views import view
from regiolith.sources import readers as R
from regiolith.streaming.runs import shared_folder

SCHEMA = "business_id long, name string, county string, naics_code string, employees int, revenue_estimate double, phone string"


@query("A1_read_registry_csv", "select business_id, name, county, naics_code, employees, revenue_estimate, null phone, 'MO' state from business")
def read_registry_csv(spark, sf_dir):
    path = shared_folder(spark, "registry")
    view(spark, sf_dir, "business").select("business_id", "name", "county", "naics_code", "employees", "revenue_estimate").write.option("header", True).csv(path)
    return R.read_registry_csv(spark, path, StructType.fromDDL(SCHEMA), "MO")


@query("A3_read_table", "select business_id, name from business")
def read_table(spark, sf_dir):
    path = shared_folder(spark, "table") + ".parquet"
    view(spark, sf_dir, "business").select("business_id", "name").write.parquet(path)
    return R.read_table(spark, path)


@query("A4_read_licenses", "select business_id, name, cast(2024 - year_established as int) age from business where business_id % 3 = 0")
def read_licenses(spark, sf_dir):
    path = shared_folder(spark, "licenses")
    b = view(spark, sf_dir, "business")
    b.select("business_id", "name", F.when(F.col("business_id") % 3 == 0, "Active").otherwise("Closed").alias("status"), F.format_string("%d-01-15", "year_established").alias("issued")).write.json(path)
    rows = spark.read.schema("business_id long, name string, status string, issued string").json(path).where("status = 'Active'")
    return rows.select("business_id", "name", (F.lit(2024) - F.year(F.col("issued").try_cast("date"))).alias("age"))


@query("A5_read_recent_crime", "select event_id, zip from crime where ts >= timestamp '2024-01-20 00:00:00'")
def read_recent_crime(spark, sf_dir):
    path = shared_folder(spark, "crime")
    view(spark, sf_dir, "crime").select("event_id", "zip", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).write.json(path)
    rows = spark.read.schema("event_id long, zip int, ts string").json(path)
    return rows.where(F.col("ts").try_cast("timestamp") >= F.expr("timestamp'2024-02-09 00:00:00' - interval 20 days")).select("event_id", "zip")


@query("A6_read_series", "select c.n_name series_id, cast(award_year as int) \"year\", 'M01' period, round(count(*) * 1000.0::double, 4) as value from award join business using (business_id) join nation c on c.n_name = county group by 1, 2")
def read_series(spark, sf_dir):
    path = shared_folder(spark, "series")
    a = view(spark, sf_dir, "award").join(view(spark, sf_dir, "business").select("business_id", "county"), "business_id")
    points = a.groupBy("county", "award_year").agg(F.count(F.lit(1)).alias("n"))
    data = points.groupBy(F.col("county").alias("seriesID")).agg(F.collect_list(F.struct(F.col("award_year").cast("string").alias("year"), F.lit("M01").alias("period"), F.col("n").cast("string").alias("value"))).alias("data"))
    data.select(F.struct(F.array(F.struct("seriesID", "data")).alias("series")).alias("Results")).write.json(path)
    return R.read_bls_series(spark, path, 1000.0, multi_line=False).withColumn("value", F.round("value", 4))


@query("A7_read_observations", "select event_type series_id, cast(cast(ts as date) as varchar) as \"date\", round(sum(value), 4) as value from events group by 1, 2")
def read_observations(spark, sf_dir):
    path = shared_folder(spark, "observations")
    g = view(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.round(F.sum("value"), 4).alias("v"))
    data = g.groupBy(F.col("event_type").alias("series_id")).agg(F.collect_list(F.struct(F.col("d").cast("string").alias("date"), F.col("v").cast("string").alias("value"))).alias("observations"))
    data.write.json(path)
    return R.read_observations(spark, path, multi_line=False).withColumn("date", F.col("date").cast("string"))


@query("A8_header_row_table", "select n_nationkey id, unnest(['name', 'region']) name, unnest([n_name, cast(n_regionkey as varchar)]) as value from nation")
def header_row_table(spark, sf_dir):
    """A table landed as one JSON array of rows of which the first is the header, over several lines, and read back."""
    path = shared_folder(spark, "header-rows")
    n = view(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("cells"))
    rows = n.agg(F.array_sort(F.collect_list("cells")).alias("cells"))  # a dimension
    header = F.array(F.array(F.lit("id"), F.lit("name"), F.lit("region")))
    rows.select(F.replace(F.to_json(F.concat(header, "cells")), F.lit("],["), F.lit("],\n["))).coalesce(1).write.text(path)
    long = R.header_row_table(spark.read.text(path, wholetext=True), "value")
    ids = long.where("name = 'id'").select("row", F.col("value").cast("long").alias("id"))
    return ids.join(long.where("name <> 'id'"), "row").select("id", "name", "value")


@query("A12_extract_point", "select business_id, round(latitude, 6) latitude, round(longitude, 6) longitude from business")
def extract_point(spark, sf_dir):
    b = view(spark, sf_dir, "business").select("business_id", F.round("latitude", 6).alias("a"), F.round("longitude", 6).alias("o"))
    k = F.col("business_id") % 4
    record = (
        F.when(k == 0, F.to_json(F.struct(F.col("a").alias("lat"), F.col("o").alias("lon"))))
        .when(k == 1, F.to_json(F.struct(F.struct(F.col("a").alias("latitude"), F.col("o").alias("longitude")).alias("location"))))
        .when(k == 2, F.to_json(F.struct(F.array("o", "a").alias("coordinates"))))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("POINT ("), F.col("o").cast("string"), F.lit(" "), F.col("a").cast("string"), F.lit(")")).alias("wkt"))))
    )
    return R.extract_point(b.select("business_id", record.alias("record"))).drop("record")


@query("A15_read_if_fresh", "select n_nationkey, n_name from nation where n_nationkey % 2 = 1")
def read_if_fresh(spark, sf_dir):
    """Two snapshots are landed; the time of the first is set back by ten days, so that only the second is within seven."""
    folder = shared_folder(spark, "snapshots")
    n = view(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for part in (0, 1):
        n.where(F.col("n_nationkey") % 2 == part).coalesce(1).write.parquet(f"{folder}/part={part}")
    now = R.set_back(spark, f"{folder}/part=0", days=10)
    return R.read_fresh(spark, folder, days=7, now=now).select("n_nationkey", "n_name")


@query("A17_save_businesses", "select business_id, name, county from business")
def save_businesses(spark, sf_dir):
    path = shared_folder(spark, "businesses")
    view(spark, sf_dir, "business").select("business_id", "name", "county").write.mode("overwrite").partitionBy("county").parquet(path)
    return spark.read.parquet(path).select("business_id", "name", "county")


@query("A18_append_runs", "select run, count(*) n from (select unnest([1, 2]) run, business_id from business) group by 1")
def append_runs(spark, sf_dir):
    path = shared_folder(spark, "runs")
    b = view(spark, sf_dir, "business").select("business_id")
    for run in (1, 2):
        b.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
    return spark.read.parquet(path).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("B1_align_schema", "select business_id, cast(employees as bigint) employees, 'unknown' status, 0.0::double score from business")
def align_schema(spark, sf_dir):
    schema = StructType.fromDDL("business_id long, employees long, status string, score double")
    return R.aligned(view(spark, sf_dir, "business").withColumn("employees", F.col("employees").cast("string")), schema, {"status": "unknown", "score": 0.0})
