"""Queries opN_<name> and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm import decontam, html_text, langid, license_scan, near_dup, packing, token_files, toxicity, vector_dup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontam": decontam.decontam_query, "op2_vector_dup": vector_dup.vector_dup_query, "op3_langid": langid.langid_query, "op4_near_dup": near_dup.near_dup_query, "op5_token_files": token_files.token_files_query, "op6_license_scan": license_scan.license_query, "op7_html_text": html_text.html_query, "op8_packing": packing.packing_query, "op9_warc": warc.warc_query, "op10_toxicity": toxicity.toxicity_query}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontam": decontam.ORACLE_SQL, "op2_vector_dup": vector_dup.ORACLE_SQL, "op4_near_dup": near_dup.ORACLE_SQL}
