from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from conftest import SF_DIR

from strandlake.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def texts():
    rng = random.Random(2)
    out = [None, "", "\n", " \t ", "a", "a b", "a b c a b c", "x\ny\nx\n x\nx", "é è\u00a0b | < > #*$%&", "one\r\none\r\n\none", "\x1c \x85 \u2028 z", "a a a a a"]
    for _ in range(80):
        out.append("".join(rng.choice(["a", "b", "é", " ", "  ", "\n", "\t", "#", "the cat sat\n"]) for _ in range(rng.randint(0, 90))))
    return out + ["long word " * 60000]


def test_counts_equal_brute_force(monkeypatch):
    for size in (1 << 21, 64):
        monkeypatch.setattr(q, "chunks", lambda offsets, size=size: __import__("strandlake.llm.base", fromlist=["chunks"]).chunks(offsets, size))
        got = q.base_counts(pa.array(texts(), pa.string()))
        want = [brute(t) for t in texts()]
        for k, name in enumerate(q.FIELDS):
            assert got[name].tolist() == [w[k] for w in want], name


def test_ratio_and_verdicts(spark):
    rng = random.Random(3)
    good = [f"g{k}" for k in range(50)]
    bad = [f"b{k}***" for k in range(50)]
    docs = [(k, " ".join(rng.choice(good if k % 4 else bad) for _ in range(200)), 0) for k in range(200)]
    docs += [(900, None, 0), (901, "", 0), (902, " ".join(rng.choice(good) for _ in range(150)), 0)]
    labels = [(k, int(k % 4 > 0), 0) for k in range(100)] + [(None, 1, 0), (3, 1, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, kept int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in q.drop_low_quality(frame, known).collect()} == {k for k in range(200) if k % 4} | {902}
    assert q.drop_low_quality(frame, known).columns == frame.columns
    v = {r.doc_id: r.v for r in q.with_verdict(frame.repartition(5), known, "v", buckets=1 << 24).collect()}
    assert v[900].n_words == 0 and v[900].base_failed and not v[900].kept
    assert {d: (round(x.llr, 4), x.kept) for d, x in v.items()} == plain_verdicts(docs, labels)


def plain_verdicts(docs, labels):
    """Means of log2(trusted / corpus) over words and word pairs, by the n-grams themselves."""
    trusted = {d for d, quality, toxic in labels if quality == 1 and toxic == 0 and d is not None}
    grams = {d: [*(w := WORD.findall(t or "")), *zip(w, w[1:], strict=False)] for d, t, *_ in docs}
    corpus, good = Counter(g for x in grams.values() for g in x), Counter(g for d, x in grams.items() if d in trusted for g in x)
    share = sum(good.values()) / sum(corpus.values())
    out = {}
    for d, t, *_ in docs:
        sums = [math.log2((good[g] + q.PRIOR) / (corpus[g] * share + q.PRIOR)) for g in grams[d]]
        mean = sum(sums) / max(1, len(sums))
        n_words, _, _, _, n_repeat = brute(t)
        out[d] = (round(mean, 4), not (n_words < 50 or 100 * n_repeat > 50 * n_words) and mean >= q.THRESHOLD)
    return out


@pytest.mark.parametrize(("slice_", "dense"), [(1 << 14, 1 << 20), (1 << 16, 1), (1 << 15, 1)])
def test_slices_give_the_same_verdicts(spark, monkeypatch, slice_, dense):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, "x"), (5, "", "y")], docs.schema))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    want = sorted(map(str, q.with_verdict(docs, labels, "LANG").collect()))
    monkeypatch.setattr(q, "SLICE", slice_)
    monkeypatch.setattr(q, "DENSE", dense)
    got = q.with_verdict(docs, labels, "LANG")
    assert sorted(map(str, got.collect())) == want and got.columns == ["doc_id", "text", "LANG"]


def test_buckets_grow_with_the_corpus(spark):
    texts = [("w" * 1000,)] * 512
    assert q.n_buckets(spark.createDataFrame(texts, "text string")) == q.LEAST_BUCKETS
    monkey = spark.range(1000).selectExpr("repeat('w', 1000000) as text")
    assert q.n_buckets(monkey) == round(q.LEAST_BUCKETS * math.sqrt(10**9 / q.LEAST_BYTES)) > 2 * q.LEAST_BUCKETS


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "w " * 80 + "x y z", 1, 2, 3), (1, " ".join(f"a{k}" for k in range(90)), 4, 5, 6)], "doc_id long, text string, quality_verdict int, trusted_id int, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in q.drop_low_quality(docs, none).collect()] == [(1, docs.collect()[1].text, 4, 5, 6)]


def test_nothing_trusted_and_empty(spark):
    frame = spark.createDataFrame([(1, "w " * 80 + "x y z")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(not r.steps.any() for r in q.ngram_ratios(frame, none))
    assert q.drop_low_quality(frame.limit(0), none).count() == 0
