"""Columns and joins that add knowledge to businesses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_flags(df: DataFrame, key: str, text: str, topics: dict[str, list[str]]) -> DataFrame:
    """(key, topic) for every topic of which a keyword occurs in the text, in any case."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = [F.when(lower.rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(topic)) for topic, words in topics.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*hits))).alias("topic"))


def prefix_lookup(df: DataFrame, code: str, table: DataFrame, default: float, name: str, lengths: tuple[int, ...] = (4, 3)) -> DataFrame:
    """Adds the value of the longest prefix of the code that the table (key, value) holds, else the default.

    The table is a dimension of constants, so it is broadcast."""
    found = []
    for n in lengths:
        side = table.select(F.col("key").alias(f"key_{n}"), F.col("value").alias(f"value_{n}")).where(F.length(f"key_{n}") == n)
        df = df.join(F.broadcast(side), F.substring(F.col(code), 1, n) == F.col(f"key_{n}"), "left")
        found.append(f"value_{n}")
    return df.withColumn(name, F.coalesce(*found, F.lit(default))).drop(*found, *[f"key_{n}" for n in lengths])


def constant_table(spark, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "key string, value double")
