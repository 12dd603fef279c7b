"""Structured Streaming over files that land in a folder, and their incremental aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    from regiolith.operators.graph import checkpoint_folder

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, table: str, files: int = 1) -> DataFrame:
    """A table of the folder as a stream of its files, some files at a time."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def finished(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what has landed, and returns the table that it leaves.

    In complete mode each batch replaces the table; in the other modes batches are added, and a batch that is
    repeated after a failure replaces itself."""
    spark = stream.sparkSession
    out, marks = shared_folder(spark, name), shared_folder(spark, f"{name}-marks")

    def keep(batch: DataFrame, number: int) -> None:
        place = f"{out}/batch=0" if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(place)

    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(stream.columns)


def counts_by_name(stream: DataFrame, name: str) -> DataFrame:
    return stream.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def rolling(stream: DataFrame, key: str, time: str, length: str, slide: str, late: str = "1 day") -> DataFrame:
    """Counts and means over sliding windows; rows later than the watermark are dropped."""
    windowed = stream.withWatermark(time, late).groupBy(key, F.window(time, length, slide).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def latest(stream: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    return stream.groupBy(key).agg(F.max_by(value, F.struct(time, tie)).alias(value), F.max(time).alias(time))


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def progress(stream: DataFrame, task: str, stage: str, value: str) -> DataFrame:
    """The furthest progress of each task and stage; it never goes back."""
    return stream.groupBy(task, stage).agg(F.max(value).alias("progress"))


def overall_progress(stream: DataFrame, task: str, stage: str, value: str, weights: dict[str, float]) -> DataFrame:
    """(task, overall, stages): the weighted progress of each task, in whole percent, and how many stages have begun.

    The state of a task is the furthest progress of each of its stages, so late and repeated rows change nothing and the
    total never falls, also over restarts, as the state is that of the stream's checkpoint. Progress counts from 0 to 100;
    stages without a weight, and rows without a stage or value, count nothing."""
    amount = F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.lit(100.0))
    furthest = [F.max(F.when(F.col(stage) == s, amount)).alias(f"stage_{i}") for i, s in enumerate(weights)]
    state = stream.groupBy(task).agg(*furthest)
    parts = [F.coalesce(F.col(f"stage_{i}"), F.lit(0.0)) / 100 * float(w) for i, w in enumerate(weights.values())]
    begun = [F.col(f"stage_{i}").isNotNull().cast("int") for i in range(len(weights))]
    return state.select(task, F.floor(sum(parts, F.lit(0.0)) + 1e-9).cast("int").alias("overall"), sum(begun, F.lit(0)).alias("stages"))


def resumed(stream: DataFrame, out: str, marks: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what has landed since its last run, from the checkpoint in ``marks``; returns the table in ``out``.

    In complete mode the table is replaced by each batch: a batch is written beside the others and the last one counts, so
    readers never see half of one. In update mode rows are added."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(out)
    if mode == "complete":
        last = found.agg(F.max("batch").alias("batch"))  # one row
        found = found.join(F.broadcast(last), "batch")
    return found.select(stream.columns)
