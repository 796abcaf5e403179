"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to function of session and folder) and ORACLES (name to SQL).
MODULES = ("suffix_dedup", "packing", "mixing", "near_dedup", "toxicity", "nearest", "pii", "url_filter", "ngram_lm", "topk", "align", "quality", "fim")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLES.items()}
