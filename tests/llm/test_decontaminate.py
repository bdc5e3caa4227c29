from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from strandlake.llm import decontaminate as dc


def words_of(text):
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]


def brute(text, items):
    out = {}
    w = words_of(text)
    for item, t in items:
        v = words_of(t)
        k = min(5, len(v))
        if not v:
            continue
        want = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
        best = None
        for s in range(len(w) - len(v) + 1):
            mine = Counter(tuple(w[s + i : s + i + k]) for i in range(len(v) - k + 1))
            both = sum((mine & want).values())
            sim = both / (2 * sum(want.values()) - both)
            if sim >= 0.8 and (best is None or sim > best[0]):
                best = (sim, s)
        if best:
            out[item] = (best[1], round(best[0], 9))
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + ["été", "naïve", "übung"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 3, 5, 8, 12, 20, 20, 33, 60])]
    items += [(20, items[7][1]), (21, ""), (22, "...")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3:
            part = rng.choice(items)[1].split()
            if d % 3 == 2 and len(part) > 30:  # an edited copy
                part = [*part[:-1], rng.choice(vocabulary)]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", " -"]) for x in part]
        docs.append((d, " ".join(w)))
    return docs + [(100, None), (101, ""), (102, items[5][1] + " " + items[5][1])], items


def test_hits_equal_brute_force(spark, cases):
    docs, items = cases
    benchmark = spark.createDataFrame([(*x, 0) for x in items] + [(30, None, 0)], "item_id long, text string, doc_id int")
    frame = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, item_id string")
    got = {r.doc_id: {h.item_id: (h.start, round(h.similarity, 9)) for h in r.hits} for r in dc.with_copied_items(frame, benchmark, "hits").collect()}
    assert got == {d: brute(t, items) for d, t in docs}
    kept = dc.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, t in docs if not brute(t, items)}


def test_passes_over_a_large_benchmark(spark, cases, monkeypatch):
    docs, items = cases
    monkeypatch.setattr(dc, "PASS_BYTES", 200)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: sorted(h.item_id for h in r.hits) for r in dc.with_copied_items(frame, benchmark, "hits").collect()}
    assert got == {d: sorted(brute(t, items)) for d, t in docs}


def test_empty_tables(spark, cases):
    docs, items = cases
    none = spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert dc.drop_contaminated(frame, none).count() == len(docs)
    assert dc.drop_contaminated(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def brute_whole(text, items):
    """brute, and a document shorter than an item as one window of its own."""
    out = {i: (s, len(words_of(dict(items)[i])), sim) for i, (s, sim) in brute(text, items).items()}
    w = words_of(text)
    for item, t in items:
        v = words_of(t)
        k = min(5, len(v))
        if not v or not k <= len(w) < len(v):
            continue
        mine, want = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (w, v))
        both = sum((mine & want).values())
        sim = both / (sum(mine.values()) + sum(want.values()) - both)
        if sim >= 0.8:
            out[item] = (0, len(w), round(sim, 9))
    return out


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))) for k, n in enumerate([3, 6, 9, 10, 14, 25, 40, 55, 59])]
    items.append((20, " ".join(["again"] * 30)))
    docs = []
    for _, t in items:
        w = t.split()
        for cut in (1, 2, 5, 8, 12):
            docs += [w[:-cut], w[cut:], w[cut // 2 : len(w) - cut + cut // 2], [*w[cut + 1 :], "other"]]
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    want = {d: brute_whole(t, items) for d, t in docs}
    assert sum(len(brute(t, items)) for _, t in docs) < sum(map(len, want.values()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: {h.item_id: (h.start, h.words, round(h.similarity, 9)) for h in r.hits} for r in dc.with_copied_items(frame, spark.createDataFrame(items, "item_id long, text string"), "hits").collect()}
    assert got == want
    assert dc.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).count() == sum(not x for x in want.values())
