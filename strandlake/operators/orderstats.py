"""Exact order statistics without a sort: the k-th value of a column, quantiles, and exactly n rows by a hash.

Two passes bring a rank's bracket down by a factor of some thousand: approximate quantiles give two values around the rank, and
a count tells how many values lie below and between them, so the bracket is certain. What is between them at last, a bounded
number of values, is counted one by one. All ranks of all columns go through the same passes, and no task holds more than a
sketch of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different values of a bracket that are counted one by one, and the precision of the sketches.
SMALL, ACCURACY = 20_000, 10_000


@dataclass
class _Bracket:
    """Values from low to high (null: without an end), `below` of them smaller, in which the value of a rank lies."""

    name: str
    rank: int
    inside: int
    below: int = 0
    low: object = None
    high: object = None
    width: float = 2.0 / ACCURACY
    stuck: bool = False  # no sketch divides these values any more

    def holds(self, x: Column) -> Column:
        return x.isNotNull() & (F.lit(True) if self.low is None else x >= F.lit(self.low)) & (F.lit(True) if self.high is None else x <= F.lit(self.high))

    def single(self) -> bool:
        return self.low is not None and (self.low == self.high or (self.low != self.low and self.high != self.high))  # NaN is the largest value, and equals itself in Spark


def order_statistics(rows: DataFrame, columns: Mapping[str, Column], ranks: Callable[[int], Sequence[int]], small: int = SMALL, accuracy: int = ACCURACY) -> dict[str, tuple[int, dict[int, object]]]:
    """For each named column (numbers or times) the count of its values and, by rank from 0, those that ranks(count) asks for.

    Nulls don't count; ranks beyond the values are left out. rows are read several times.
    """
    if not columns:
        return {}
    counts = rows.agg(*(F.count(x).alias(name) for name, x in columns.items())).first()
    out: dict[str, tuple[int, dict[int, object]]] = {name: (counts[name], {}) for name in columns}
    todo = [_Bracket(name, k, counts[name], width=2.0 / accuracy) for name in columns for k in sorted(set(ranks(counts[name]))) if 0 <= k < counts[name]]
    while True:
        wide = [b for b in todo if b.inside > small and not b.single() and not b.stuck]
        if not wide:
            break
        shares = [(b.rank - b.below + 0.5) / b.inside for b in wide]
        near = rows.agg(*(F.percentile_approx(F.when(b.holds(columns[b.name]), columns[b.name]), [max(0.0, p - b.width), min(1.0, p + b.width)], accuracy).alias(f"q{k}") for k, (b, p) in enumerate(zip(wide, shares, strict=True)))).first()
        counted = []
        for k, b in enumerate(wide):
            x = columns[b.name]
            counted += [F.count_if(x < F.lit(near[k][0])).alias(f"b{k}"), F.count_if(x <= F.lit(near[k][1])).alias(f"e{k}")]
        counts_of = rows.agg(*counted).first()
        for k, b in enumerate(wide):
            below, end = counts_of[f"b{k}"], counts_of[f"e{k}"]
            if below <= b.rank < end and (end - below < b.inside or near[k][0] == near[k][1]):
                b.low, b.high, b.below, b.inside = near[k][0], near[k][1], below, end - below
            else:
                b.stuck, b.width = b.width >= 1, b.width * 4
    rest = [b for b in todo if not b.single()]
    for b in todo:
        if b.single():
            out[b.name][1][b.rank] = b.low
    for name in {b.name for b in rest}:
        own = [b for b in rest if b.name == name]
        x = columns[name]
        at = F.array(*(F.when(b.holds(x), F.lit(k)) for k, b in enumerate(own)))
        each = rows.select(x.alias("value"), F.explode(F.array_compact(at)).alias("k")).groupBy("k", "value").agg(F.count("*").alias("n"))
        passed = [b.below for b in own]
        for r in each.orderBy("k", "value").collect():  # what small brackets hold
            b = own[r.k]
            if b.rank not in out[name][1] and passed[r.k] <= b.rank < passed[r.k] + r.n:
                out[name][1][b.rank] = r.value
            passed[r.k] += r.n
    return out


def quantiles(rows: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], **how: int) -> dict[str, list[float | None]]:
    """Exact quantiles, interpolated between neighbours; null without values."""

    def ends(n: int) -> list[int]:
        return [f(s * (n - 1)) for s in shares for f in (math.floor, math.ceil)] if n else []

    out: dict[str, list[float | None]] = {}
    for name, (n, value) in order_statistics(rows, columns, ends, **how).items():
        found: list[float | None] = []
        for s in shares:
            at = s * (n - 1)
            lo, hi = math.floor(at), math.ceil(at)
            found.append(None if not n else float(value[lo]) if lo == hi else (hi - at) * float(value[lo]) + (at - lo) * float(value[hi]))
        out[name] = found
    return out


def first_by(rows: DataFrame, n: int, order: Column, ties: Sequence[str] = (), **how: int) -> DataFrame:
    """Exactly n rows (or all) with the least `order`, a text of hexadecimal digits such as an md5; of equal ones by `ties`.

    The first 15 digits are a number whose n-th value bounds the rows; only rows on that bound are sorted.
    """
    if n <= 0:
        return rows.limit(0)
    key = F.conv(F.substring(order, 1, 15), 16, 10).cast("long")
    count, found = order_statistics(rows, {"key": key}, lambda m: [n - 1], **how)["key"]
    if n >= count:
        return rows
    bound = found[n - 1]
    below = rows.filter(key < F.lit(bound))
    on = rows.filter(key == F.lit(bound)).orderBy(order, *ties).limit(n - below.count())
    return below.unionByName(on)
