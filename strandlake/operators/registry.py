"""Named enrichers (DataFrame to DataFrame), applied in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

Enricher = Callable[..., DataFrame]
_KNOWN: dict[str, Enricher] = {}


def enricher(name: str | None = None) -> Callable[[Enricher], Enricher]:
    """Registers a function under a name (default: its own)."""

    def add(f: Enricher) -> Enricher:
        _KNOWN[name or f.__name__] = f
        return f

    return add


def names() -> list[str]:
    return list(_KNOWN)


def enrich(rows: DataFrame, which: Sequence[str] | None = None, **context: object) -> DataFrame:
    """rows through the named enrichers (default: all), in order."""
    for name in which if which is not None else _KNOWN:
        rows = _KNOWN[name](rows, **context)
    return rows
