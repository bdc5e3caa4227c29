"""Distributions: tail probabilities as column functions, for tables of one row a test."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, from its end."""
    out = 1.0
    for m in range(200, 0, -1):
        k = m // 2
        num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        out = 1.0 + num / out
    return 1.0 / out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def student_quantile(share: float, df: float) -> float:
    """The t below which lies the share, at least a half, by halving."""
    low, high = 0.0, 1.0
    while 1 - student_tail(high, df) / 2 < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - student_tail(middle, df) / 2 < share else (low, middle)
    return (low + high) / 2


def chi2_tail(x: float, df: float) -> float:
    """Upper p-value of chi-squared: the sum of the series where it ends soon, else a continued fraction from its end."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = 0
        while term > total * 1e-16:
            k += 1
            term *= y / (a + k)
            total += term
        return max(0.0, 1 - front * total)
    out = y + 1 - a + 2 * 300
    for k in range(300, 0, -1):
        out = y + 1 - a + 2 * (k - 1) - k * (k - a) / out
    return front / out


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def tail(f: Callable[..., float], *args: Column) -> Column:
    """f of the columns row by row; null where one of them is, or isn't a number."""

    @F.arrow_udf("double")
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = zip(*(x.to_pylist() for x in batch), strict=True)
            yield pa.array([None if any(x is None or math.isnan(x) for x in r) else f(*r) for r in rows], pa.float64())

    if len(args) == 1:
        return tail(lambda x, _: f(x), args[0], F.lit(0.0))
    return of(*(a.cast("double") for a in args))
