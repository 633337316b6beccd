"""Queries of the corpus operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, html_extract, language_id, mixing, packing, pii, pipeline, quality, simhash, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_html_extract": html_extract.query,
        "op3_host_quality": quality.query,
        "op4_substring_dedup": substring_dedup.query,
        "op5_mix_sources": mixing.query,
        "op6_token_counts": token_counts.query,
        "op7_pii": pii.query,
        "op8_simhash": simhash.query,
        "op9_pack": packing.query,
        "op10_language_id": language_id.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op3_host_quality": quality.SQL,
        "op4_substring_dedup": substring_dedup.SQL,
    }
