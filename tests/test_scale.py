"""What queries send about: figures that must not grow faster than the input."""

from __future__ import annotations

import hashlib
import random

import pytest
from test_operators import brute_evaluate

from strandlake.operators import evaluate, joins


def stages(spark, frame):
    """(stages of the run of a frame, its rows)."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def every():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): found.apply(k) for k in range(found.size())}

    before = every().keys()
    rows = frame.collect()
    return [s for k, s in every().items() if k not in before], rows


def test_entity_pairs_are_not_shuffled(spark):
    rows = [(k, f"n{k}", 1, k % 7, 1000 + k % 11) for k in range(300)]
    genes = spark.createDataFrame(rows, "id long, symbol string, chrom int, start long, end long")
    ran, pairs = stages(spark, joins.entity_pairs(genes, genes))
    assert len(pairs) == 90_000
    assert sum(s.shuffleWriteRecords() for s in ran) < 20_000


def test_entity_pairs_of_one_place_are_dealt_out(spark, monkeypatch):
    """All pairs of a chromosome's one bin come from many tasks, which hold few rows of it, and no side is computed again."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(joins, "WORTH", 1000, raising=False)
    genes = spark.createDataFrame([(k, f"n{k % 2}" if k < 90 else None, 1, k % 7, 1000 + k % 11) for k in range(300)], "id long, symbol string, chrom int, start long, end long")
    made = joins.entity_pairs(genes, genes, edge=30)
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = made.withColumn("task", F.spark_partition_id()).collect()
    by_task = {}
    for r in rows:
        by_task[r.task] = by_task.get(r.task, 0) + 1
    assert len(rows) == len({(r.id_1, r.id_2) for r in rows}) == 90_000 and max(by_task.values()) < 10_000
    assert sum(r.strategy == "id" for r in rows) == 300 and sum(r.strategy == "symbol" for r in rows) == 90 * 45 - 90


def test_entity_pairs_of_repeated_ids(spark):
    rng = random.Random(4)

    def side():
        return [(rng.choice([None, *range(8)]), rng.choice([None, *"abcd"]), rng.randint(1, 2), s := rng.randint(0, 40), s + rng.randint(0, 30)) for _ in range(25)]

    a, b = side(), side()
    want = {}
    for i, s, c, lo, hi in a:
        for j, t, d, lo2, hi2 in b:
            found = []
            if i is not None and i == j:
                found.append((1, "id", 1.0))
            if s is not None and s == t:
                found.append((2, "symbol", 0.7 if [x[1] for x in a].count(s) > 1 or [x[1] for x in b].count(s) > 1 else 0.9))
            share = (min(hi, hi2) - max(lo, lo2) + 1) / max(hi - lo + 1, hi2 - lo2 + 1)
            if c == d and share >= 0.5:
                found.append((3, "coordinate", round(0.5 + 0.4 * share, 9)))
            if found:
                want[i, j] = min(*found, want[i, j]) if (i, j) in want else min(found)
    kinds = "id long, symbol string, chrom int, start long, end long"
    got = [((r.id_1, r.id_2), (r.strategy, round(r.confidence, 9))) for r in joins.entity_pairs(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), bin_width=10).collect()]
    assert len(got) == len(want) and dict(got) == {k: v[1:] for k, v in want.items()}


def test_composition_entropy_runs_no_pattern_a_letter(spark):
    """All letters of a string are counted at once, whatever its alphabet."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from strandlake.functions import sequences

    texts = [None, "", "aaaa", "abcd", "a \\E.b*" * 9, "ééa" * 5, "a\U0001f600\U0001f601\U0001f600", "".join(map(chr, range(32, 127)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", sequences.composition_entropy(F.col("s")).alias("e"))
    assert "RegExpCount" not in (plan := frame._jdf.queryExecution().toString()) and "regexp_count" not in plan
    for i, e in frame.collect():
        n = Counter(texts[i] or "").values()
        want = -sum(k / sum(n) * math.log2(k / sum(n)) for k in n)
        assert (e is None) == (texts[i] is None) and (e is None or abs(e - want) < 1e-9)

@pytest.mark.parametrize("mode", [evaluate.RANDOM, evaluate.PROXIMITY, evaluate.WINDOW])
def test_evaluation_deals_more_rows_to_more_tasks(spark, monkeypatch, mode):
    """A task sorts no more rows when there are more, and what it chooses is the same."""
    monkeypatch.setattr(evaluate, "TASK_ROWS", 100, raising=False)
    rng = random.Random(31)
    scores, true, want = [(None, 1, 0.9), (40, 5, 0.9), (40, 6, 0.1)], [(None, 1)], set()  # gene 40 has no site
    for g in range(40):
        s = [(p, 0.9 if g % 5 and rng.random() < 0.1 else 0.1) for p in sorted(rng.sample(range(-200, 800), 50))]
        t = rng.sample(range(-200, 800), 6)
        scores, true = scores + [(g, *x) for x in s], true + [(g, p) for p in t]
        called = brute_evaluate(dict(s), t, 0.5, 2)
        positive = [p for p, kind in called if kind in ("TP", "FP")]
        gap = {p: min((abs(p - q) for q in positive), default=None) for p, kind in called if kind == "TN"}
        hashed = {p: (hashlib.md5(f"42|{g}|{p}".encode()).hexdigest(), p) for p in gap}
        wanted, left = int(1.2 * (len(called) - len(gap))), list(gap)
        if mode == evaluate.WINDOW and len(gap) > wanted and positive:
            left = [p for p in gap if gap[p] <= 50]
        left.sort(key=lambda p: (gap[p], p) if mode == evaluate.PROXIMITY and positive else hashed[p])
        want |= {(g, *x) for x in called if x[1] != "TN"} | {(g, p, "TN") for p in left[:wanted]}
    ran, got = stages(spark, evaluate.evaluate(spark.createDataFrame(scores, "gene long, position long, score double"), spark.createDataFrame(true, "gene long, position long"), "gene", "long", "score", tn_factor=1.2, tn_mode=mode))
    assert sorted(tuple(x)[:3] for x in got) == sorted(want)
    assert max(s.numTasks() for s in ran) >= len(scores) / 100
