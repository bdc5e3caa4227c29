"""Ranks and running sums in one order over all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(rows: DataFrame, col: str, parts: int) -> Column:
    """The number of edges, approximate quantiles of the column, below a value: buckets in order, of about equal size."""
    edges = sorted(set(rows.approxQuantile(col, [k / parts for k in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(col))) if edges else F.lit(0)


def running(values: DataFrame, col: str, n: str, parts: int = 64) -> DataFrame:
    """values, which has a row for each value of col, with `before`: the sum of n over all smaller values.

    A bucket is one task's share; what all earlier buckets have comes from a table with one row a bucket. Nulls are not
    allowed in col.
    """
    marked = values.withColumn("bucket", _bucket(values, col, parts))
    sums = marked.groupBy("bucket").agg(F.sum(n).alias("s"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.join(F.broadcast(offsets), "bucket").withColumn("before", F.col("offset") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return out.drop("bucket", "offset")


def least_from(values: DataFrame, col: str, of: str, name: str, parts: int = 64) -> DataFrame:
    """values with `name`: the least `of` among this value of col and all larger ones."""
    marked = values.withColumn("bucket", _bucket(values, col, parts))
    least = marked.groupBy("bucket").agg(F.min(of).alias("m"))
    later = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = least.select("bucket", F.min("m").over(later).alias("beyond"))
    inside = Window.partitionBy("bucket").orderBy(F.col(col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(F.broadcast(beyond), "bucket").withColumn(name, F.least(F.min(of).over(inside), "beyond")).drop("bucket", "beyond")


def with_mean_rank(rows: DataFrame, col: str, name: str, parts: int = 64) -> DataFrame:
    """rows with the rank of col from 1 on, equal values sharing the mean of their ranks; null for null."""
    counts = rows.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("ranked_value")).agg(F.count("*").alias("ranked_n"))
    ranks = running(counts, "ranked_value", "ranked_n", parts).select("ranked_value", (F.col("before") + (F.col("ranked_n") + 1) / 2).alias(name))
    return rows.join(ranks, F.col(col) == F.col("ranked_value"), "left").drop("ranked_value")
