from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from strandlake.llm import mixing


def brute_targets(sizes: dict, most=3):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    total, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = total / sum(weight[k] for k in open_)
        full = {k for k in open_ if most * sizes[k] <= share * weight[k]}
        if not full:
            target.update({k: share * weight[k] for k in open_})
            break
        for k in full:
            target[k] = most * sizes[k]
            total -= target[k]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for k in range(900):
        source = rng.choice(["a"] * 12 + ["b", "c", "é", "Z", None])
        out.append((k, " ".join("x" for _ in range(rng.randint(1, 60))), source))
    out += [(5000 + k, t, "tiny") for k, t in enumerate(["one", "two words"])]
    out += [(6000, None, "a"), (6001, "", "nothing"), (None, "no id here", "b"), (6002, "twice", "c"), (6002, "twice", "c"), (6003, "y\u00a0z " * 4, "c")]
    return out


def test_mix(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string")
    both, copies = mixing.mixed_copies(docs)
    got = [r.asDict() for r in mixing._on(both, copies, "doc_id", "source").selectExpr("docs.doc_id", "docs.source", "docs.size", "source_size", "target", "mix.copies").collect()]
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 61, s
    again = mixing._on(*mixing.mixed_copies(docs.repartition(7)), "doc_id", "source").selectExpr("docs.doc_id", "docs.source", "docs.size", "mix.copies").collect()
    assert sorted(map(repr, ((r.doc_id, r.source, r.size, r.copies) for r in again))) == sorted(map(repr, ((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got)))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_expectation(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 5), "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    n = defaultdict(float)
    for seed in range(12):
        for r in mixing.mixed_copies(docs, seed=seed * 1000)[1].collect():
            n[r.source] += r.copies / 12 / 20
    rate = {r.source: r.target / r.source_size for r in mixing.mixed_copies(docs)[1].select("source", "target", "source_size").distinct().collect()}
    for s in rate:
        assert n[s] == pytest.approx(rate[s], abs=0.12)


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")
    assert mixing._on(*mixing.mixed_copies(blank), "doc_id", "source").count() == 2
