"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module that has it.
MODULES = {
    "op1_packing": "packing",
    "op2_language": "language",
    "op3_simhash": "simhash",
    "op4_token_files": "token_files",
    "op5_compaction": "compaction",
    "op6_sentencepiece": "pieces",
    "op7_toxicity": "toxicity",
    "op8_prefix_hashes": "prefix_hashes",
    "op9_licenses": "licenses",
    "op10_neighbours": "neighbours",
    "op11_filter_audit": "filter_audit",
    "op12_ranked_search": "ranked_search",
    "op13_substring_dedup": "substring_dedup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {q: getattr(importlib.import_module(f"passplane.llm.{m}"), q) for q, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, where SQL can express the query."""
    out = {}
    for q, m in MODULES.items():
        if sql := getattr(importlib.import_module(f"passplane.llm.{m}"), "ORACLE_SQL", None):
            out[q] = sql
    return out
