"""DuckDB inside Spark's tasks: SQL over bounded Arrow batches that Spark has partitioned."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    import duckdb

#: Memory of a task's database. It spills nowhere, so what is put into it must be bounded.
MEMORY = "400MB"


def connect() -> duckdb.DuckDBPyConnection:
    """A database in memory for one task, on the one core that the task has."""
    import duckdb  # loaded by the tasks that ask it, as every worker holds what it has loaded

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})


def ask(con: duckdb.DuckDBPyConnection, sql: str, **tables: pa.Table | pa.RecordBatch) -> pa.Table:
    """The result of a statement over Arrow tables given by name."""
    for name, rows in tables.items():
        con.register(name, pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, merge: Callable[[pa.Table], pa.Table] | None = None) -> Iterator[pa.Table]:
    """Tables of about `most` rows that never end within a run of equal keys; the batches are sorted by these.

    A run of more rows is shortened by `merge`, which must leave its sums as they are.
    """
    held: list[pa.Table] = []
    n = 0

    def cut(rows: pa.Table) -> int:
        """Where the last run begins."""
        at = rows.num_rows - 1
        same = None
        for k in keys:
            last = rows.column(k)[at]
            equal = pc.equal(rows.column(k), last) if last.is_valid else pc.is_null(rows.column(k))
            equal = pc.fill_null(equal, False)
            same = equal if same is None else pc.and_(same, equal)
        return pc.index(same, True).as_py()

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
        if n >= most:
            rows = pa.concat_tables(held)
            at = cut(rows)
            if at:
                yield rows.slice(0, at)
                rows = rows.slice(at)
            if merge is not None and rows.num_rows >= most:
                rows = merge(rows)
            held, n = [rows], rows.num_rows
    if n:
        yield pa.concat_tables(held)
