"""Queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from ledgerloom.llm import chat, decontaminate, jaccard, licenses, linededup, lm, packing, quality, sharding, suffixes

    return {
        "op1_jaccard_join": jaccard.query,
        "op2_lm_scoring": lm.query,
        "op3_best_fit_packing": packing.query,
        "op4_line_dedup": linededup.query,
        "op5_license_scan": licenses.query,
        "op6_decontaminate": decontaminate.query,
        "op10_sharding": sharding.query,
        "op7_suffix_dedup": suffixes.query,
        "op8_chat_formatting": chat.query,
        "op9_quality_rules": quality.query,
        "op4_passage_dedup": linededup.passage_query,
    }


def oracle_sql() -> dict[str, str]:
    from ledgerloom.llm import chat, decontaminate, jaccard, linededup, suffixes

    return {
        "op1_jaccard_join": jaccard.ORACLE,
        "op4_line_dedup": linededup.ORACLE,
        "op6_decontaminate": decontaminate.ORACLE,
        "op7_suffix_dedup": suffixes.ORACLE,
        "op8_chat_formatting": chat.ORACLE,
        "op4_passage_dedup": linededup.PASSAGE_ORACLE,
    }
