"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import embedding, language, lines, mixing, pieces, quality, sharding, simhash, suffix, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_embedding_near_dedup": embedding.query,
        "op3_exact_topk": topk.query,
        "op4_mixing": mixing.query,
        "op5_sentencepiece": pieces.query,
        "op6_line_dedup": lines.query,
        "op7_suffix_dedup": suffix.query,
        "op8_sharding": sharding.query,
        "op9_quality": quality.query,
        "op10_language": language.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op2_embedding_near_dedup": embedding.ORACLE, "op3_exact_topk": topk.ORACLE, "op6_line_dedup": lines.ORACLE}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
