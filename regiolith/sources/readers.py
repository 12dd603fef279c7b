"""Readers that turn landed files into tables, with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def unified(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources one after another, each row tagged with the name of its source; missing columns are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def aligned(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The columns of the schema in its order: cast where they exist, defaults where they are missing or unreadable."""
    defaults = defaults or {}
    columns = []
    for field in schema:
        kind = field.dataType.simpleString()
        found = F.col(field.name).try_cast(kind) if field.name in df.columns else F.lit(None).cast(kind)
        columns.append(F.coalesce(found, F.lit(defaults.get(field.name)).cast(kind)).alias(field.name))
    return df.select(columns)


def read_registry_csv(spark: SparkSession, path: str, schema: StructType, state: str) -> DataFrame:
    """A registry of one state from CSV files with a header."""
    raw = spark.read.option("header", True).csv(path)
    return aligned(raw, schema).withColumn("state", F.lit(state))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet, by the ending of the path."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def read_bls_series(spark: SparkSession, path: str, scale: float = 1000.0, multi_line: bool = True) -> DataFrame:
    """(series_id, year, period, value) from nested labour statistics."""
    kind = "Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string>>>>>"
    series = spark.read.schema(kind).option("multiLine", multi_line).json(path).select(F.explode("Results.series").alias("s"))
    points = series.select(F.col("s.seriesID").alias("series_id"), F.explode("s.data").alias("d"))
    return points.select("series_id", F.col("d.year").try_cast("int").alias("year"), "d.period", (F.col("d.value").try_cast("double") * scale).alias("value"))


def read_observations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(series_id, date, value) from observation files; values that are not numbers are dropped."""
    kind = "series_id string, observations array<struct<date: string, value: string>>"
    points = spark.read.schema(kind).option("multiLine", multi_line).json(path).select("series_id", F.explode("observations").alias("o"))
    return points.select("series_id", F.col("o.date").try_cast("date").alias("date"), F.col("o.value").try_cast("double").alias("value")).where("value is not null")


def header_row_table(df: DataFrame, column: str) -> DataFrame:
    """(row, name, value) from JSON texts that hold an array of rows of which the first is the header."""
    rows = df.select(F.from_json(column, "array<array<string>>").alias("rows"))
    named = rows.select(F.get("rows", F.lit(0)).alias("header"), F.posexplode(F.slice("rows", 2, 1_000_000)).alias("row", "cells"))
    return named.select("row", F.explode(F.map_from_arrays("header", "cells")).alias("name", "value"))


def extract_point(df: DataFrame) -> DataFrame:
    """Adds latitude and longitude from lat and lon, a location object, a [lon, lat] array or a WKT point, first match wins."""
    def of(path: str):
        return F.get_json_object("record", path).try_cast("double")

    wkt = F.coalesce(F.get_json_object("record", "$.wkt"), F.lit(""))
    wkt_lon, wkt_lat = (F.regexp_extract(wkt, r"POINT\s*\((-?[\d.]+)\s+(-?[\d.]+)\)", i).try_cast("double") for i in (1, 2))
    lat = F.coalesce(of("$.lat"), of("$.location.latitude"), of("$.coordinates[1]"), wkt_lat)
    lon = F.coalesce(of("$.lon"), of("$.location.longitude"), of("$.coordinates[0]"), wkt_lon)
    return df.withColumn("latitude", lat).withColumn("longitude", lon)


def read_if_fresh(spark: SparkSession, path: str, oldest: str) -> DataFrame:
    """Rows of the Parquet files that were changed at a time or later."""
    return spark.read.parquet(path).where(F.col("_metadata.file_modification_time") >= F.lit(oldest).cast("timestamp"))


def read_fresh(spark: SparkSession, path: str, days: float, now: str) -> DataFrame:
    """Rows of the Parquet files that were changed within so many days before a time."""
    oldest = F.expr(f"timestamp'{now}' - interval {int(days * 86_400)} seconds")
    return spark.read.parquet(path).where(F.col("_metadata.file_modification_time") >= oldest)


def set_back(spark: SparkSession, path: str, days: float) -> str:
    """Sets the files of a folder back by so many days; returns the time of the latest one before."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    latest = spark.read.parquet(path).agg(F.max("_metadata.file_modification_time").cast("string").alias("t")).first()["t"]
    for f in system.listStatus(files):
        system.setTimes(f.getPath(), f.getModificationTime() - int(days * 86_400_000), -1)
    return latest
