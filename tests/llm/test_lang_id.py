from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR

from strandlake.llm import lang_id as li


def brute_bits(train: list[bytes], text: bytes, order: int = 4, least: int = 2) -> float:
    """The same code length, from nested counters."""
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for t in train:
        p = b"\n" * order + t
        for k in range(order, len(p)):
            for o in range(order + 1):
                counts[p[k - o : k]][p[k]] += 1
    for c in list(counts):
        if len(c) > 2:
            counts[c] = Counter({s: n for s, n in counts[c].items() if n >= least})
    total, p = 0.0, b"\n" * order + text
    for k in range(order, len(p)):
        for o in range(order, -1, -1):
            seen = counts.get(p[k - o : k]) or Counter()
            n, kinds = sum(seen.values()), len(seen)
            if p[k] in seen:
                total -= math.log2(seen[p[k]] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds)) if kinds else 0
        else:
            total += 8
    return total


def test_code_lengths(spark):
    train = {"en": ["the cat sat on the mat the cat sat", "that hat and the hat", "él niño", "", "aaaaaaaaaaaa"], "de": ["der hut und die katze und der hut", "", None, "ß" * 9]}
    docs = spark.createDataFrame([(k * 7 + 1 + 100 * (lang == "de"), t, lang) for lang, own in train.items() for k, t in enumerate(own)], "doc_id long, text string, lang string")
    model = li.learn(docs)
    assert model.langs == ["de", "en"]
    texts = [b"the hat", b"zebra", b"", "ñandú the und der hut".encode(), b"q", b"aaaaaaaaaa", b"\xff\x00", b"the cat sat on the mat"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = model.bits(np.frombuffer(b"".join(texts), np.uint8), offsets) / li.STEPS
    for k, lang in enumerate(model.langs):
        used = [t.encode() for j, t in enumerate(train[lang]) if t is not None and zlib.crc32(str(j * 7 + 1 + 100 * (lang == "de")).encode()) % 5]
        for i, text in enumerate(texts):
            assert got[i, k] == pytest.approx(brute_bits(used, text), abs=5 * max(1, len(text)) / li.STEPS)


def test_lookup():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**40, 5000))
    lookup = li.Lookup(keys)
    assert (lookup(keys) == np.arange(len(keys))).all() and len(lookup.rest) > 100
    other = np.setdiff1d(rng.integers(0, 2**40, 9000), keys)
    assert (lookup(other) == -1).all()
    assert li.Lookup(keys[:0])(other).tolist() == [-1] * len(other)


def test_a_small_model_keeps_what_is_common(spark, monkeypatch):
    rows = [(k, f"common words {'abcdefghij'[k % 10]} rare{k} rare{k}", "en") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    for cells in (1 << 25, 120, 1):
        monkeypatch.setattr(li, "CELLS", cells)
        model = li.learn(docs)
        sizes.append(sum(len(x.keys) for x in model.entries[3:]))
        assert len(model.entries[2].keys) > 100
    assert sizes[0] > 500 and 0 < sizes[1] <= 120 and sizes[2] == 0


def test_repeated_and_long_rows(spark):
    long = "the cat and the hat " * 40_000
    docs = spark.createDataFrame([(1, long, "en"), (1, long, "en"), (None, "der hut und die katze", "de"), (3, "der hut und die katze", "de"), (4, long + "x", None)], "doc_id long, text string, lang string")
    model = li.learn(docs)
    got = docs.select("doc_id", li.predict("text", model, spark).alias("p")).collect()
    assert [r.p.lang_pred for r in got] == ["en", "en", "de", "de", "en"] and got[0].p == got[1].p


def test_held_out_accuracy(spark):
    rows = li.query(spark, SF_DIR.replace("sf0.001", "sf0.01")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(SF_DIR.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_unknown(spark):
    docs = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi", None), (3, None, "en"), (4, "123 !?", "de"), (5, "", "en"), (6, "Ω", "en"), (7, "٣", "en")], "doc_id long, text string, lang string")
    model = li.learn(docs)
    got = {r.doc_id: r.p for r in docs.select("doc_id", li.predict("text", model, spark).alias("p")).collect()}
    assert [got[k].lang_pred for k in (3, 4, 5, 7)] == ["und"] * 4
    assert got[6].lang_pred in model.langs and got[3].score == 0
    nothing = li.learn(docs.limit(0))
    assert {r.p.lang_pred for r in docs.select(li.predict("text", nothing, spark).alias("p")).collect()} == {"und"}
    assert docs.limit(0).select(li.predict("text", model, spark).alias("p")).count() == 0
