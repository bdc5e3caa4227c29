"""Registration of queries with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, more: str = "", name: str | None = None, recursive: bool = False) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Registers a function of the views under its name; sql is a statement over the views, or None where SQL can't tell it."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql, more, recursive)
        return f

    return add


def r6(**columns: Column) -> list[Column]:
    """Columns rounded to six places, under their names."""
    return [F.round(v, 6).alias(k) for k, v in columns.items()]


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def longs(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})
