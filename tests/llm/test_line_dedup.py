from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from strandlake.llm import line_dedup as ld


def edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, a: bytes, n: int) -> bytes:
    b = bytearray(a)
    for _ in range(n):
        k, how = rng.randint(0, len(b)), rng.randint(0, 2)
        if how == 0 or not b:
            b.insert(k, rng.choice(b"abc"))
        elif how == 1:
            del b[min(k, len(b) - 1)]
        else:
            b[min(k, len(b) - 1)] = rng.choice(b"abc")
    return bytes(b)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_distance(most, monkeypatch):
    rng = random.Random(most)
    monkeypatch.setattr(ld, "CELLS", 4000)
    first = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    second = [changed(rng, a, rng.randint(0, 5)) for a in first]
    assert ld.within_edits(first, second, most).tolist() == [edits(a, b) <= most for a, b in zip(first, second, strict=True)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_close_lines_share_a_key(most):
    rng = random.Random(50 + most)
    for _ in range(400):
        a = bytes(rng.choice(b"abcd") for _ in range(rng.randint(8, 40)))
        b = changed(rng, a, rng.randint(1, most))
        if a == b or edits(a, b) > most or len(b) < 8:
            continue
        raw = np.frombuffer(a + b"\n" + b, np.uint8)
        index, probe = defaultdict(set), defaultdict(set)
        for which, key, probing in ld.segment_keys(raw, np.array([0, len(a) + 1]), np.array([len(a), len(a) + 1 + len(b)]), most):
            for x, y in zip(which.tolist(), key.tolist(), strict=True):
                (probe if probing else index)[x].add(y)
        assert index[0] & probe[1] or index[1] & probe[0]
        sketch = ld.sketches(raw, np.array([0, len(a) + 1]), np.array([len(a), len(a) + 1 + len(b)]))
        assert ld.agree(sketch[:1], sketch[1:], most)[0]


def near(a: str, b: str, most: int, share: float) -> bool:
    x, y = a.encode(), b.encode()
    budget = min(most, int(share * max(len(x), len(y)) + 1e-9))
    return abs(len(x) - len(y)) <= budget and edits(x, y) <= budget


def brute(docs, most=2, share=ld.SHARE):
    """Numbers of the lines to remove, by document."""
    seen: dict[str, tuple[int, int]] = {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                seen.setdefault(line, (d, n))
    names = list(seen)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if near(a, b, most, share):
                root[find(a)] = find(b)
    first: dict[str, tuple[int, int]] = {}
    for x in names:
        first[find(x)] = min(first.get(find(x), seen[x]), seen[x])
    return {d: [n for n, line in enumerate((t or "").split("\n")) if line in seen and (d, n) != first[find(line)]] for d, t in docs}


@pytest.mark.parametrize(("share", "hot"), [(ld.SHARE, ld.HOT), (1.0, ld.HOT), (1.0, 12), (ld.SHARE, 6)])
def test_removed_lines_equal_brute_force(spark, share, hot, monkeypatch):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 60))) + "x" for _ in range(40)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool)
            lines.append(changed(rng, line.encode(), rng.choice([0, 0, 1, 2, 3])).decode() if rng.random() < 0.6 else "".join(rng.choice("pqrst") for _ in range(30)))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "\t"]))
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "0123456789\n012345678\n01234567\nz\nyz\nqwerty\nqwertz")]
    docs += [(200 + d, "\n".join(f"Invoice number {rng.randint(0, 10**5):05d} was issued by the head office" for _ in range(12))) for d in range(8)]
    close = ld.close_lines
    monkeypatch.setattr(ld, "close_lines", lambda *x: close(*x, hot=hot))
    want = brute(docs, share=share)
    frame = spark.createDataFrame([(*x, 3) for x in docs], "doc_id long, text string, line int")
    got = {r.doc_id: list(r.gone) for r in ld.with_repeated_lines(frame, "n", "gone", share=share).collect()}
    assert got == want
    out = {r.doc_id: r.text for r in ld.drop_repeated_lines(frame, share=share).collect()}
    for d, t in docs:
        assert out[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d]))


def test_rows_without_ids_and_with_equal_ids(spark):
    a, b = "first line that is quite long", "second line that is quite long"
    kinds = "doc_id long, text string, removed int, n_lines string, lines int, id int, name string"
    docs = [(None, f"{a}\n{b}", 1, "p", 0, 0, ""), (None, f"a third line, of yet other words\n{a}", 2, "q", 0, 0, ""), (4, "the fourth line of this test", 3, "r", 0, 0, ""), (4, "a fifth one stands here, too\nthe fourth line of this test", 4, "s", 0, 0, ""), (4, "the fourth line of this test", 5, "t", 0, 0, "")]
    got = ld.drop_repeated_lines(spark.createDataFrame(docs, kinds))
    assert got.columns == [x.split()[0] for x in kinds.split(", ")]
    text = {r.removed: r.text for r in got.collect()}
    everything = "\n".join(text.values()).split("\n")
    assert {a, b, "a third line, of yet other words", "the fourth line of this test", "a fifth one stands here, too"} <= set(everything)
    assert everything.count(a) == everything.count(b) == 1
    assert text[3] == text[5]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.drop_repeated_lines(docs).count() == 0


@pytest.mark.parametrize(("block", "hot"), [(60, 1000), (1000, 1000), (1000, 50)])
def test_a_large_key_is_expanded_in_blocks(block, hot, monkeypatch):
    rng = np.random.default_rng(3)
    key = np.concatenate((np.full(400, 5), rng.integers(6, 60, 300)))
    ids, probe = rng.integers(0, 500, 700), rng.random(700) < 0.5
    sketch = rng.integers(0, 2**60, 500)[ids // 20 * 20]
    sizes, agree = [], ld.agree
    monkeypatch.setattr(ld, "PAIRS", block)
    monkeypatch.setattr(ld, "agree", lambda a, b, edits: (sizes.append(len(a)), agree(a, b, edits))[1])
    rows = [r for batch in ld.meeting_pairs(key, ids, probe, sketch, hot=hot) for r in batch.to_pylist()]
    got = {(r["a"], r["b"]) for r in rows if r["b"] is not None}
    want = set()
    for i in np.flatnonzero(~probe):
        for j in np.flatnonzero(probe & (key == key[i])):
            if (key[i] != 5 or hot == 1000) and ids[i] != ids[j] and agree(sketch[[i]], sketch[[j]])[0]:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert got == want and want
    assert max(sizes) <= max(block, 400)
    assert {(r["a"], r["probe"]) for r in rows if r["b"] is None} == ({*zip(ids[:400].tolist(), probe[:400].tolist(), strict=True)} if hot == 50 else set())
