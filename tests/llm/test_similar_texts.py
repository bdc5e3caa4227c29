from __future__ import annotations

import random

import pytest
from conftest import SF_DIR

from strandlake.llm import similar_texts as st


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and (a == b or len(a & b) * 5 >= len(a | b) * 4):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def groups(rows):
    rows = rows.collect()
    least: dict[int, int] = {}
    for r in rows:
        least[r.root] = min(least.get(r.root, r.id), r.id)
    return {r.id: least[r.root] for r in rows}


@pytest.mark.parametrize("slice_size", [6, 4000])
def test_groups_equal_brute_force(spark, slice_size):
    rng = random.Random(21)
    docs = []
    for k in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        docs.append((k, " ".join(words)))
        for v in range(4):  # similarities around the threshold
            other = list(words)
            for at in rng.sample(range(0, 300, 5), 3 + 2 * v):
                other[at] = "changed"
            docs.append((1000 * (v + 1) + k, " ".join(other).upper()))
    chain = [f"c{k}" for k in range(400)]
    docs += [(9000 + k, " ".join(chain[8 * k : 8 * k + 200])) for k in range(20)]  # links from one to the next
    docs += [(8001, None), (8002, ""), (8003, "a b"), (8004, "A\nb"), (8005, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert groups(st.similar_rows(frame, slice_size=slice_size)) == brute(docs)


def test_edited_copies_of_one_text(spark):
    """A large group in which many are too far from all others: these don't multiply the pairs."""
    rng = random.Random(23)
    words = [f"w{k}" for k in range(200)]
    docs = [(0, " ".join(words))]
    for k in range(1, 150):
        other = list(words)
        for at in rng.sample(range(0, 200, 6), rng.randint(0, 9)):
            other[at] = f"x{rng.randint(0, 10**9)}"
        docs.append((k, " ".join(other)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert groups(st.similar_rows(frame)) == brute(docs)


def test_stage_drops_copies_at_the_threshold(spark):
    import corpus_pipeline as cp

    rng = random.Random(22)
    docs = []
    for k in range(60):
        words = [f"w{rng.randint(0, 9000)}" for _ in range(200)]
        docs.append((k, " ".join(words)))
        docs.append((100 + k, " ".join(["new" if i in (20, 80, 140) else w for i, w in enumerate(words)])))  # 181 of 211 shingles
        docs.append((200 + k, " ".join(["new" if i % 24 == 8 else w for i, w in enumerate(words)])))  # below 0.8
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in cp.near_dedup_stage(spark, frame, SF_DIR).collect()}
    assert kept == {k for k in range(60)} | {200 + k for k in range(60)}


def test_one_row_of_each_group_stays(spark):
    from pyspark.sql import Row

    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    kinds = "doc_id long, text string, root int, no_id string, near_copy_key int"
    docs = [(3, a, 1, "x", 1), (5, a, 2, "x", 2), (5, b, 3, "x", 3), (None, b + " c", 4, "y", 4), (None, "one text", 5, "y", 5), (None, "another text", 6, "y", 6), (7, None, 7, "z", 7), (8, "", 8, "z", 8), (9, "twice", 10, "z", 9), (9, "twice", 9, "z", 9), (2**63 - 1, "the last id", 11, "z", 1)]
    got = st.drop_similar_texts(spark.createDataFrame(docs, kinds))
    assert got.columns == ["doc_id", "text", "root", "no_id", "near_copy_key"]
    assert sorted(r.root for r in got.collect()) in ([1, 3, 5, 6, 7, 10, 11], [1, 3, 5, 6, 7, 9, 11])
    kept = {r.root: r for r in got.collect()}
    assert min(kept[k].root for k in kept if k in (9, 10)) == 10  # as JSON, 10 comes before 9
    assert kept[1] == Row(doc_id=3, text=a, root=1, no_id="x", near_copy_key=1)
    assert st.drop_similar_texts(spark.createDataFrame([], kinds)).count() == 0


def test_the_trie_finds_near_copies(spark, monkeypatch):
    """Links of the fingerprint trie are candidates too, and what they link is compared exactly."""
    monkeypatch.setattr(st, "AGREE", st.BANDS * st.ROWS + 1)  # min-hashes find nothing
    rng = random.Random(24)
    docs = []
    for k in range(20):
        words = [f"w{rng.randint(0, 9000)}" for _ in range(400)]
        docs += [(k, " ".join(words)), (100 + k, " ".join([*words[:-1], "new"])), (200 + k, " ".join(words[:200]))]
    got = groups(st.similar_rows(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute(docs)
    assert all(want[d] == least or d == least for d, least in got.items())
    assert sum(got[100 + k] == k for k in range(20)) >= 15
