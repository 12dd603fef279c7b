"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regiolith.llm import backoff, bytebpe, html, jaccard, media, merkle, packing, pieces, quality, rules, secrets, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_backoff": backoff.op1_backoff,
        "op2_html": html.op2_html,
        "op3_media": media.op3_media,
        "op4_quality": quality.op4_quality,
        "op5_rules": rules.op5_rules,
        "op6_secrets": secrets.op6_secrets,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_packing": packing.op10_packing,
        "op11_merkle": merkle.op11_merkle,
        "op12_bpe": bytebpe.op12_bpe,
        "op13_trie": trie.op13_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return backoff.ORACLES | rules.ORACLES
