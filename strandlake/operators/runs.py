"""Functions of one group at a time, over partitions that are sorted by group: no frame is made for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def for_each_group(rows: DataFrame, by: Sequence[str], columns: Sequence[str], order: Sequence[str], schema: str, of: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """The rows that `of` makes from each group's rows (of the columns, in the given order), after the columns `by`.

    A group is one list, so it should be small; a partition's groups follow each other. schema names what `of` gives.
    """
    n = len(by)
    out_schema = StructType([*rows.select(*by).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out_schema)
    dealt = rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, *order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    if key is not None:
                        out += [key + x for x in of(held)]
                    key, held = row[:n], []
                held.append(row[n:])
            yield table(out)
        if key is not None:
            yield table([key + x for x in of(held)])

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(scan, out_schema)
