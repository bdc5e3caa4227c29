from __future__ import annotations

import numpy as np
import pytest
import xxhash
from conftest import SF_DIR

from strandlake.llm import near_dedup as nd


def plain_print(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members: dict[int, list] = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(ids[i])
    return {find(i): min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(ids))}, [find(i) for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b  C\td e f g " * 9, "éÈ ß x\u00a0y z w", "w " * 70000])
def test_fingerprint(text):
    assert nd.simhashes((text or "").encode()) == [plain_print(text)]
    four = nd.simhashes((text or "").encode(), families=4)
    assert four[0] == plain_print(text) and len(four) == 4


def test_groups_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "  "), (None, rows[0][1]), (9004, rows[1][1]), (9004, rows[1][1]), (9005, rows[2][1].replace("the", "teh", 1))]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, fp int, id string")
    got = sorted(((r.id, r.fp, r.component_id) for r in nd.near_copy_groups(docs).collect()), key=repr)
    prints = [plain_print(t) for _, t in rows]
    least, find = plain_groups([a for a, _ in rows], prints)
    want = sorted(((a, int(np.uint64(p).astype(np.int64)), least[f]) for (a, _), p, f in zip(rows, prints, find, strict=True)), key=repr)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_copy_groups(docs).count() == 0
    assert nd.drop_near_copies(docs).count() == 0


@pytest.mark.parametrize("subtree", [2, 8, 4000])
def test_links_join_all_components(spark, subtree):
    rng = np.random.default_rng(5)
    codes = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for c in codes[:20]:
        for _ in range(60 if c == codes[0] else 12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                c ^= 1 << int(b)
            codes.append(c)
    codes = sorted(set(codes))
    frame = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    links = nd.hamming_links(frame, subtree=subtree)
    for a, b in links.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 64
    roots = {r.node: r.root for r in nd.components(links).collect()}
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    _, find = plain_groups(signed, codes)
    groups: dict[int, set] = {}
    for s, f in zip(signed, find, strict=True):
        groups.setdefault(f, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100 + k * 7 % 31, 100 + (k + 1) * 7 % 31) for k in range(31)] + [(5, 5)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(31)}}


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten " * 6
    other = "quite another text with words of its own"
    docs = [(3, text, "a"), (1, text.upper().replace(" ", "\n"), "b"), (7, other, "c"), (7, other, "c"), (7, text, "d"), (None, "a text without an id", "e"), (None, "one more text, also without", "f"), (None, other, "g"), (9, None, "h"), (10, " ", "i")]
    got = nd.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string, fp string"))
    assert got.columns == ["doc_id", "text", "fp"]
    assert sorted(r.fp for r in got.collect()) == ["b", "c", "e", "f", "h"]


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "same words here and there"), (None, "same words here and there"), (None, "quite other words in this one")], "doc_id long, text string")
    assert all(r.id is None and r.component_id is None for r in nd.near_copy_groups(docs).collect())
    assert nd.drop_near_copies(docs).count() == 2


def test_more_families_find_more_copies(spark):
    import random

    rng = random.Random(12)
    docs = []
    for k in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        docs.append((k, " ".join(words)))
        for _ in range(2):
            words[rng.randint(0, 299)] = "changed"
        docs.append((1000 + k, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    caught = [sum(r.component_id == r.id - 1000 for r in nd.near_copy_groups(frame, families=f).collect()) for f in (1, 4)]
    assert caught[0] < caught[1] and caught[1] >= 35
    groups = nd.near_copy_groups(frame, families=4).collect()
    assert all(r.component_id % 1000 == r.id % 1000 for r in groups)
    assert nd.drop_near_copies(frame).count() == 80 - caught[1]
