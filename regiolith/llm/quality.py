"""Quality scores by compression: dictionaries of good and of bad text, and the difference they make.

Zstandard dictionaries are trained on all blocks of the whole texts of a bounded sample of labelled rows of each class.
A text is cut into blocks, and each block is compressed apart with either dictionary, so that the dictionary and not
the text's own repetition decides. Differences of two sizes, normalised by their sum, are the only inputs of the score:
between the bad dictionary and the good one over the whole text and for those of its blocks where it is least (a poor
passage may lie in a good text), and between either one, no dictionary, the text as one piece, and the text itself.
Logistic regression calibrates these differences and their products.

A null or empty text is scored from sizes of 0 and gets a constant score between 0 and 1. Without labels the
score is the constant 0.5. Labels are read only outside the held-out fold; text is the only input of a score.
Repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiolith.llm import fitting
from regiolith.llm.common import fold, is_held_out, map_rows, table, texts, training_rows

#: Labelled rows of each class that the model is fitted on: a bounded sample.
PER_CLASS = 2_000
#: Bytes that are compressed at once.
BLOCK = 384
DICTIONARY = 64 * 1024
LEVEL = 3
THRESHOLD = 0.3
#: Shares of the blocks, the poorest first, whose last difference counts.
SHARES = (0.0, 0.1, 0.33)
DIFFERENCES = 7 + len(SHARES)
FEATURES = DIFFERENCES * (DIFFERENCES + 3) // 2

UPPER = np.triu_indices(DIFFERENCES)


@dataclass
class Model:
    good: bytes
    bad: bytes
    calibration: fitting.Calibration


def blocks_of(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Differences:
    """Normalised differences of the sizes of a text compressed with the bad dictionary and with the good one."""

    def __init__(self, good: bytes, bad: bytes):
        def primed(content: bytes):
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False)

        self.good, self.bad, self.plain = primed(good).compress, primed(bad).compress, primed(b"").compress

    def features(self, text: str) -> list[float]:
        """The differences and their products of two, which let the calibration bend."""
        x = np.array(self.differences(text))
        return [*x, *np.outer(x, x)[UPPER]]

    def differences(self, text: str) -> list[float]:
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return [0.0] * DIFFERENCES
        blocks = blocks_of(data)
        good, bad, plain = (np.array([len(c(b)) for b in blocks]) for c in (self.good, self.bad, self.plain))
        g, b, p, whole, n = good.sum(), bad.sum(), plain.sum(), len(self.plain(data)), len(data)
        least = np.sort((bad - good) / (bad + good))
        size = np.array([len(x) for x in blocks])
        size = size[2 * size > BLOCK] if len(size) > 1 else size  # a short rest compresses badly
        packed = np.sort((size - good[: len(size)]) / (size + good[: len(size)]))
        between = lambda x, y: (x - y) / (x + y)
        return [between(b, g), between(p, g), between(p, b), between(p, whole), between(n, g), between(n, b), packed[-1], *(least[int(share * len(least))] for share in SHARES)]


def blocks_of_sample(sample: DataFrame) -> DataFrame:
    """(doc_id, y, at, block): all blocks of the texts of a bounded sample of rows."""

    def task():
        def step(block):
            out = {"doc_id": [], "y": [], "at": [], "block": []}
            for doc_id, text, y in zip(block["doc_id"], block["text"], block["y"]):
                found = blocks_of(text.encode("utf-8", "surrogatepass"))
                out["doc_id"] += [doc_id] * len(found)
                out["y"] += [y] * len(found)
                out["at"] += range(len(found))
                out["block"] += found
            return out

        return step

    return map_rows(sample, task, "doc_id long, y int, at long, block binary")


def dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        return b""


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Half of the sample, by a hash of doc_id, trains the dictionaries; the other half calibrates."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    share = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    sample = training_rows(docs, labels, "quality", per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    rows = sorted(
        (r["y"], r["doc_id"], r["at"], bytes(r["block"])) for r in blocks_of_sample(sample.where("half = 0").drop("half")).collect()
    )
    good = dictionary([b for y, _, _, b in rows if y == 1])
    bad = dictionary([b for y, _, _, b in rows if y == 0])

    def task():
        found = Differences(good, bad)

        def step(block):
            return {"doc_id": block["doc_id"], "y": block["y"], "x": [found.features(t) for t in block["text"]]}

        return step

    held = map_rows(sample.where("half = 1").drop("half"), task, "doc_id long, y int, x array<double>").collect()
    held.sort(key=lambda r: (r["doc_id"], r["y"]))
    x = np.array([r["x"] for r in held]).reshape(len(held), FEATURES)
    return Model(good, bad, fitting.fit(x, np.array([r["y"] for r in held]), 0.5 if share is None else share))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def task():
        found = Differences(model.good, model.bad)

        def step(block):
            return {"doc_id": block["doc_id"], "score": [model.calibration(found.features(t)) for t in block["text"]]}

        return step

    scored = map_rows(texts(docs), task, "doc_id long, score double")
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
