"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed to a Python function at once; keeps a worker's memory small when texts are long.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that text operators read; a null text is the empty text."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fold(key: str | Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % folds


def is_held_out(key: str | Column) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))


def map_rows(
    df: DataFrame,
    fn: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
    rows: int = ROWS_AT_ONCE,
) -> DataFrame:
    """mapInArrow over column lists. ``fn()`` runs once for each task and returns the function of a block,
    so caches live in the task; a block is a dict of column lists, and so is its result."""
    out = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        step = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                block = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                made = step(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, out)


def shared_folder(spark: SparkSession) -> str:
    """The session's folder of checkpoints, which driver and executors share; a local one only where they are one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="regiolith-checkpoint-")  # tests and small runs
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The same rows, written as a table and read back: in the given folder, or in a new one of the shared folder."""
    folder = folder or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sampled_texts(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text) of the documents with the first ids by a hash. Ids are chosen without their texts."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def balanced_sample(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label 0 and 1, the first by a hash of doc_id: a bounded sample."""
    parts = [
        labelled.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for v in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of labelled rows outside the held-out fold.

    The sampled ids number at most twice ``per_class``, which bounds the broadcast."""
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
        .dropDuplicates(["doc_id"])
    )
    chosen = balanced_sample(ids, "y", per_class)
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, y) of all labelled rows outside the held-out fold; of two labels of one id the higher counts.

    Both sides are dealt by doc_id at every size, and the texts are not sorted: labels grow with the documents, so they are
    never broadcast."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold("doc_id") != 0))
    return texts(docs.where(fold("doc_id") != 0)).join(ids.groupBy("doc_id").agg(F.max("y").alias("y")).hint("shuffle_hash"), "doc_id")
