"""Tests, ranks, folds and features against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators import evaluate, metrics, ranks, sampling, tables


def test_tails():
    assert stats.student_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.student_tail(0.0, 3) == pytest.approx(1.0)
    assert stats.student_tail(-5.0, 1) == pytest.approx(0.12566592, abs=1e-7)
    assert stats.student_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-6)
    assert stats.student_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-5)
    assert stats.chi2_tail(3.8414588, 1) == pytest.approx(0.05, abs=1e-7)
    assert stats.chi2_tail(10, 5) == pytest.approx(0.0752352, abs=1e-6)
    assert stats.chi2_tail(1, 5) == pytest.approx(0.9625658, abs=1e-6)
    assert stats.chi2_tail(200, 50) == pytest.approx(1.6e-20, rel=0.1)
    assert stats.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-7)


def mean_ranks(x):
    order = sorted(x)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in x]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_running_and_ranks(spark, parts):
    rng = random.Random(parts)
    x = [float(rng.randint(-40, 40)) for _ in range(300)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k long, x double").repartition(3)
    got = {r.k: r["rank"] for r in ranks.with_mean_rank(frame, "x", "rank", parts).collect()}
    assert [got[k] for k in range(300)] == mean_ranks(x)
    values = frame.groupBy("x").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    before = {r.x: (r.before, r.least) for r in ranks.least_from(ranks.running(values, "x", "n", parts), "x", "k", "least", parts).collect()}
    last = {v: max(k for k, w in enumerate(x) if w == v) for v in x}
    assert before == {v: (sum(w < v for w in x), min(last[w] for w in last if w >= v)) for v in set(x)}


def test_false_discovery(spark):
    rng = random.Random(2)
    p = [rng.choice([0.001, 0.01, 0.04, 0.2, 0.5, 1.0, rng.random()]) for _ in range(200)] + [float("nan"), -1.0, 2.0]
    clean = [v if 0 <= v <= 1 else 1.0 for v in p]
    order = sorted(range(len(p)), key=lambda k: clean[k])
    q, low = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, clean[order[rank - 1]] * len(p) / rank)
        q[order[rank - 1]] = low
    out = {r.k: r.q for r in metrics.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "k long, p double"), "p").collect()}
    assert [out[k] for k in range(len(p))] == pytest.approx(q)


def test_paired_tests(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(2, 12))) for _ in range(60)] + [(None, 1.0)]
    frame = spark.createDataFrame(rows, "a double, b double")
    d = [a - b for a, b in rows if a is not None and a != b]
    r = mean_ranks([abs(v) for v in d])
    plus, minus = sum(x for x, v in zip(r, d, strict=True) if v > 0), sum(x for x, v in zip(r, d, strict=True) if v < 0)
    got = metrics.signed_ranks(frame, "a", "b").first()
    assert (got.n, float(got.w_plus), float(got.w_minus)) == (len(d), plus, minus)
    assert got.p == pytest.approx(stats.normal_tail(got.z)) and got.z < 0
    one = metrics.paired(frame, "a", "b").first()
    assert one.n == 60 and one.p == pytest.approx(stats.student_tail(one.t, 59))


def test_feature_tests_and_folds(spark):
    rng = random.Random(5)
    rows = [(k % 2 == 0, rng.gauss(1.0 * (k % 2), 1), rng.choice("ab") if k % 3 else "ac"[k % 2]) for k in range(200)]
    frame = spark.createDataFrame(rows, "y boolean, x double, c string")
    got = {r.feature: r for r in metrics.feature_tests(frame, F.col("y"), ["x"], ["c"]).collect()}
    assert got["x"].test == "welch" and got["x"].p < 1e-3 and got["x"].importance == pytest.approx(-math.log10(max(got["x"].p, 1e-10)))
    assert got["c"].test == "chi2" and got["c"].df == 2 and 0 <= got["c"].p < 0.01
    folds = spark.createDataFrame([(0.5, 0.1), (0.7, 0.1), (0.9, 0.4)], "f1 double, r double")
    s = {r.metric: r for r in metrics.fold_summary(folds, ["f1", "r"]).collect()}
    half = 4.302653 * math.sqrt(0.08 / 3) / math.sqrt(3)
    assert (s["f1"].mean, s["f1"].ci_low, s["f1"].ci_high) == pytest.approx((0.7, 0.7 - half, 0.7 + half), abs=1e-5)


def test_policies_folds_and_fills(spark):
    rows = spark.createDataFrame([(g, p, "FP" if p < g else "TN", c) for g, c in ((1, "1"), (2, "2"), (3, "X")) for p in range(5)], "gene_id long, position long, pred_type string, chrom string")
    for policy, want in (("error_total", {3}), ("error_fp", {3}), ("all", {1, 2, 3}), ("hard", {3})):
        assert {r.gene_id for r in metrics.choose_groups(rows, ["gene_id"], policy, 1).collect()} == want
    assert len({r.gene_id for r in metrics.choose_groups(rows, ["gene_id"], "random", 2).collect()}) == 2
    with pytest.raises(ValueError):
        metrics.choose_groups(rows, ["gene_id"], "custom")
    folds = sampling.leave_out_folds(rows, "chrom", "gene_id", [["1", "2"], ["X"], ["Y"]]).collect()
    assert {r.fold for r in folds} == {"1,2", "X"} and len(folds) == 30
    assert all((r.role == "test") == (r.chrom in r.fold.split(",")) for r in folds)
    assert len({(r.fold, r.gene_id, r.role) for r in folds}) == 6
    some = spark.createDataFrame([(None, None, None, "FP"), (1.5, "x", True, "TN")], "a double, b string, c boolean, pred_type string")
    assert [tuple(r) for r in tables.fill_by_kind(some).collect()] == [(0.0, "unknown", False, "FP"), (1.5, "x", True, "TN")]
    assert tables.fill_by(some, {"a": 9.0, "zz": 1}).first().a == 9.0
    labelled = tables.positive_label(some)
    assert [r.label for r in labelled.collect()] == [1, 0] and tables.positive_label(labelled).columns == labelled.columns


def test_kmer_columns(spark):
    rows = spark.createDataFrame([(1, "ACACGT"), (2, "NNAC"), (3, ""), (4, None)], "id long, s string")
    got = {r.id: r for r in tables.kmer_features(rows, "id", "s", [2], least=2).collect()}
    assert [c for c in got[1].asDict() if c.startswith("2mer")] == ["2mer_AC"]
    assert [got[k]["2mer_AC"] for k in (1, 2, 3, 4)] == [2, 1, 0, 0]
    assert got[4].sequence_length == 0 and got[3].gc_content == 0 and got[2].sequence_complexity == pytest.approx(1.5)


@pytest.mark.parametrize("window", [0, 2, 5])
def test_matching(spark, window):
    rng = random.Random(window)
    rows, want = [], set()
    for key in range(12):
        true, called = sorted(rng.sample(range(60), rng.randint(0, 20))), sorted(rng.sample(range(60), rng.randint(0, 40)))
        positive = {p for p in called if rng.random() < 0.6}
        rows += [(key, p, evaluate.SITE) for p in true] + [(key, p, evaluate.POSITIVE if p in positive else evaluate.NEGATIVE) for p in called]
        free = list(true)
        for p in called:
            t = next((t for t in free if abs(p - t) <= window), None)
            if p not in positive:
                want |= {(key, p, "TN", None)} if t is None else set()
                continue
            want.add((key, p, "FP", None) if t is None else (key, p, "TP", t))
            if t is not None:
                free.remove(t)
        want |= {(key, t, "FN", t) for t in free}
    got = evaluate.matched(spark.createDataFrame(rows, "key long, position long, kind int").repartition(3), "key", "long", window)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
