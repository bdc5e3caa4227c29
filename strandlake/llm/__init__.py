"""Training-data operators: each module holds one operator, its query and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, divergence, lang_id, line_dedup, mixing, near_dedup, quality, secrets, sharding, token_blocks, url_filter, warc

_MODULES = (decontaminate, token_blocks, near_dedup, line_dedup, mixing, url_filter, lang_id, sharding, secrets, quality, warc, conversations, divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of every operator, by name."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
