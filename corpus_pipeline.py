"""A corpus from documents: toxic and poor ones go, one of each near-duplicate group stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents;
the last returns the pieces of the packed sequences.

A null or empty text scores as clean, and goes at the quality rules, which ask for 50 words. A row without doc_id is
judged by its text like any other and is nobody's near duplicate. Of rows equal in doc_id and text one stays; rows that
only share the doc_id stay or go by their own groups. Ties between near duplicates go to the least doc_id. An empty table
gives an empty result with the same columns. Further columns of documents, whatever their names, pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regiolith.llm import jaccard, packing, rules, secrets, toxicity
from regiolith.llm.common import checkpointed, table

#: Words of a shingle, and the least Jaccard of near duplicates in percent; op9_jaccard has its own.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filter_quality(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_with_public_tokenizer(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the scores of the first stage; the tests hold the rules, the near duplicates, the masks and the packing
#: against brute-force versions, and the scores against labels that were held out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is checkpointed before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
