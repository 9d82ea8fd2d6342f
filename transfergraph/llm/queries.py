"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontam, language_id, line_dedup, mixing, pii, prefix_trie, quality_rules, simhash, substring_dedup, toxicity, vector_codes, weak_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_quality_rules": quality_rules.op2,
        "op3_simhash_trie": simhash.op3,
        "op4_chat_format": chat_format.op4,
        "op5_substring_fm": substring_dedup.op5,
        "op6_language_cnn": language_id.op6,
        "op7_weak_quality": weak_quality.op7,
        "op8_toxicity_ftrl": toxicity.op8,
        "op9_decontaminate": decontam.op9,
        "op10_line_dedup": line_dedup.op10,
        "op11_pii_crf": pii.op11,
        "op12_vector_codes": vector_codes.op12,
        "op13_conversation_trie": prefix_trie.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.ORACLE,
        "op4_chat_format": chat_format.ORACLE,
        "op5_substring_fm": substring_dedup.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_conversation_trie": prefix_trie.ORACLE,
    }
