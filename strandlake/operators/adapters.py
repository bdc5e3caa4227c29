"""Adapters from a model's own columns to the engine's, and selection of features by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ADAPTERS: dict[str, dict[str, Callable[[DataFrame], Column]]] = {}
_FILTERS: dict[str, Callable[[DataFrame, Sequence[str]], list[str]]] = {}


def adapter(model: str, columns: dict[str, Callable[[DataFrame], Column]]) -> None:
    """Registers how a model's rows give each column of the engine."""
    _ADAPTERS[model] = columns


def adapt(rows: DataFrame, model: str, schema: T.StructType) -> DataFrame:
    """rows in the schema: by the model's adapter, else by name, else null."""
    known = _ADAPTERS[model]
    return rows.select(*((known[f.name](rows) if f.name in known else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def feature_filter(name: str):
    """Registers a function that picks features."""

    def add(f: Callable[[DataFrame, Sequence[str]], list[str]]):
        _FILTERS[name] = f
        return f

    return add


def pick(rows: DataFrame, features: Sequence[str], *names: str, how: str = "intersection") -> list[str]:
    """Features that all, or any, of the named filters pick, in their given order."""
    sets = [set(_FILTERS[n](rows, features)) for n in names]
    chosen = set.intersection(*sets) if how == "intersection" else set.union(*sets)
    return [f for f in features if f in chosen]


@feature_filter("sparsity")
def _not_sparse(rows: DataFrame, features: Sequence[str], least: float = 0.01, most: float = 0.99) -> list[str]:
    one = rows.agg(*(F.avg((F.col(f) > 0).cast("double")).alias(f) for f in features)).first()
    return [f for f in features if one[f] is not None and least <= one[f] <= most]


@feature_filter("variance")
def _varied(rows: DataFrame, features: Sequence[str], least: float = 1e-4) -> list[str]:
    one = rows.agg(*(F.var_pop(f).alias(f) for f in features)).first()
    return [f for f in features if one[f] is not None and one[f] >= least]


adapter(
    "nested_scores",
    {"score": lambda rows: F.greatest("donor_prob", "acceptor_prob"), "donor_score": lambda rows: F.col("donor_prob"), "acceptor_score": lambda rows: F.col("acceptor_prob"), "neither_score": lambda rows: 1 - F.col("donor_prob") - F.col("acceptor_prob"), "position": lambda rows: F.col("absolute_position")},
)
