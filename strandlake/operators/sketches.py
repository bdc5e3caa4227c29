"""Quantile sketches that are stored and merged: of batches, of files, and of the micro-batches of a stream.

A sketch (KLL) of parameter k takes some kilobytes whatever it has seen; merged in any order, sketches answer for all their rows
together, with a rank that is off by at most `rank_error(k)` of the rows, with 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 200


def rank_error(k: int = K) -> float:
    """The share of all rows by which the rank of an answered quantile may be off."""
    return 2.296 / k**0.9723


def quantile_sketches(rows: DataFrame, by: Sequence[str], col: str, k: int = K) -> DataFrame:
    """(by, sketch) of a numeric column; nulls don't count."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """(by, sketch): one sketch for all of each group."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def answers(sketches: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, n, share, value): what each sketch says of the shares; a group without values has no row."""
    n = F.kll_sketch_get_n_double("sketch")
    known = sketches.filter(F.col("sketch").isNotNull()).select(*by, n.alias("n"), "sketch").filter("n > 0")
    each = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for s in shares)))
    return known.select(*by, "n", each.alias("x")).select(*by, "n", "x.*")


def sketch_stream(stream: DataFrame, by: Sequence[str], col: str, path: str, checkpoint: str, k: int = K):
    """Starts a query that stores the sketches of each micro-batch in a folder of its own below path, over all there is, and ends.

    A batch that is done again after a failure replaces its folder, so no row counts twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        quantile_sketches(batch, by, col, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
