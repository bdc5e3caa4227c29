"""Order statistics against sorted lists, and sketches against exact ranks."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import orderstats, sampling, sketches, tables


def test_ranks_in_many_rounds(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, float(rng.randint(-5, 5)), rng.gauss(0, 1), 10.0 ** rng.randint(-300, 300)]), rng.choice([None, 7, rng.randint(-(2**60), 2**60)]), datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 10**6))) for _ in range(6000)]
    frame = spark.createDataFrame(rows, "a double, b long, c timestamp").repartition(7)
    columns = {x: F.col(x) for x in "abc"}
    got = orderstats.order_statistics(frame, columns, lambda n: [0, 1, n // 3, n // 2, n - 1, n, -1], small=40, accuracy=50)
    for k, name in enumerate("abc"):
        values = sorted(r[k] for r in rows if r[k] is not None)
        n = len(values)
        assert got[name] == (n, {i: values[i] for i in (0, 1, n // 3, n // 2, n - 1)})


@pytest.mark.parametrize("values", [[], [None], [1.0], [3.0, 1.0], [float("nan"), 1.0, 2.0, float("nan")], [0.0] * 500 + [1.0], [float("inf"), float("-inf"), 5.0]])
def test_edges(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    n, got = orderstats.order_statistics(frame, {"x": F.col("x")}, lambda n: range(n), small=3, accuracy=10)["x"]
    assert n == len(known) and [str(got[k]) for k in range(n)] == [str(v) for v in known]


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=3001), 2)
    frame = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    shares = [0, 0.013, 0.25, 0.5, 0.9, 1]
    got = orderstats.quantiles(frame, {"x": F.col("x")}, shares, small=30, accuracy=100)["x"]
    assert got == pytest.approx(np.quantile(x, shares).tolist())
    assert orderstats.quantiles(frame.limit(0), {"x": F.col("x")}, shares)["x"] == [None] * 6
    binned = tables.bins_by_quantile(frame.unionByName(spark.createDataFrame([(None,)], "x double")), "x", 4)
    assert {r["bin"] for r in binned.collect()} == {-1, 0, 1, 2, 3, 4}


@pytest.mark.parametrize("n", [0, 1, 100, 999, 1000, 5000])
def test_exactly_n_rows_by_hash(spark, n):
    rows = [(k % 700, k) for k in range(1000)]
    frame = spark.createDataFrame(rows, "a long, b long")
    order = sampling.hash_order(3, "a")
    got = sorted(tuple(r) for r in orderstats.first_by(frame, n, order, ["b"], small=20, accuracy=50).collect())
    want = sorted(sorted(rows, key=lambda r: (hashlib.md5(f"3|{r[0]}".encode()).hexdigest(), r[1]))[:n])
    assert got == want


def test_same_rows_all_tie(spark):
    frame = spark.createDataFrame([(1,)] * 50, "a long")
    assert sampling.sample_rows(frame, 20, ["a"]).count() == 20


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(9)
    rows = [(k % 3, k % 40, rng.choice([rng.gauss(0, 1), rng.expovariate(1), 2.0])) for k in range(30_000)] + [(0, 0, None), (9, 0, None)]
    frame = spark.createDataFrame(rows, "g int, part int, x double")
    parts = sketches.quantile_sketches(frame, ["g", "part"], "x", 100)
    shares = [0.0, 0.1, 0.5, 0.9, 0.999]
    for order in ("part", "-part", "hash(part)"):
        said = sketches.answers(sketches.merged(parts.orderBy(F.expr(order)), ["g"], 100), ["g"], shares).collect()
        assert {r.g for r in said} == {0, 1, 2} and {r.n for r in said} == {10_000}
        for r in said:
            own = np.array([x for g, _, x in rows if g == r.g and x is not None])
            assert (own < r.value).mean() - 2 * sketches.rank_error(100) <= r.share <= (own <= r.value).mean() + 2 * sketches.rank_error(100)
    assert sketches.rank_error(200) < 0.0134 < sketches.rank_error(100)


def test_sketches_of_a_stream(spark, tmp_path):
    """Files that come in two runs have one answer, and a second start adds nothing."""
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    rng = random.Random(4)
    rows = [(k % 2, rng.random()) for k in range(4000)]
    schema = "g int, x double"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        sketches.sketch_stream(stream, ["g"], "x", out, check, 100).awaitTermination()
        parts = spark.read.parquet(out).select("g", "sketch")
        return {r.g: (r.n, r.value) for r in sketches.answers(sketches.merged(parts, ["g"], 100), ["g"], [0.5]).collect()}

    spark.createDataFrame(rows[:2500], schema).repartition(3).write.parquet(folder)
    assert {g: n for g, (n, _) in run().items()} == {0: 1250, 1: 1250}
    spark.createDataFrame(rows[2500:], schema).repartition(2).write.mode("append").parquet(folder)
    for _ in range(2):
        got = run()
        assert {g: n for g, (n, _) in got.items()} == {0: 2000, 1: 2000}
        assert all(abs(v - 0.5) < 0.06 for _, v in got.values())
