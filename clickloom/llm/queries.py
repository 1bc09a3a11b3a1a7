"""Registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import decontamination, media, near_dedup, page_text, personal_data, sentencepiece_bpe, substring_dedup, token_counts, token_shards, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece_bpe.query,
        "op2_toxicity": toxicity.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_minhash_near_dedup": near_dedup.query,
        "op5_token_counts": token_counts.query,
        "op6_page_text": page_text.query,
        "op7_personal_data": personal_data.query,
        "op8_media": media.query,
        "op9_decontamination": decontamination.query,
        "op10_token_shards": token_shards.query,
        "rollup_of_word_counts": token_counts.word_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op4_minhash_near_dedup": near_dedup.ORACLE,
        "rollup_of_word_counts": token_counts.ORACLE,
        "op9_decontamination": decontamination.ORACLE,
    }
