"""All registered queries of the library proper and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of plans; each has QUERIES and SQL by query name.
PLANS = ["decisions", "zones", "texts", "rasters", "pictures", "scenes", "stores"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in PLANS:
        out |= getattr(importlib.import_module(f"passplane.plans.{name}"), attribute)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return _merged("SQL")
