from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SF_DIR, same_rows
from pyspark.sql import functions as F

from strandlake.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def edits_of(rows, most_inserts):
    """Every (cost, audit, lines) that the grammar allows, by trying all edits of all turns."""
    found = []

    def go(i, cost, audit, initials, lines, inserted):
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            found.append((cost, audit, lines))
        if inserted < most_inserts:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", initials + role[0], [*lines, f"{role}:"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", initials, lines, inserted)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in tuple("sua"):
                    go(i + 1, cost + more, audit + "K", initials + role[0], [*lines, f"{role}:{text}"], inserted)
                for to in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", initials + to[0], [*lines, f"{to}:{text}"], inserted)

    go(0, 0, "", "", [], 0)
    return found


def brute(rows, live=None, most_inserts=2):
    """The report of one conversation's (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, r or " " if r is None else r, hashlib.md5(x.encode()).digest(), x) for t, r, x in ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows)))
    seen, faulty = set(), []
    for _, _, role, _, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for known, t, *_ in rows if known]
    kinds = [f for *_, f in faulty]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
    cost, audit, lines = min(edits_of(faulty, most_inserts), key=lambda x: x[:2])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_sql(spark, duck):
    df = cv.query(spark, SF_DIR)
    rel = duck.sql(cv.SQL)
    same_rows((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall()))


def made(n, longest, seed):
    rng = random.Random(seed)
    texts = ["Hello.", "Yes?", "No", "", " \t", "Why!  ", "é", "Hello."]
    roles = ["user", "assistant", "system", "tool", "", None, "Unicorn", "user", "assistant"]
    return {k: [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice([*texts, None])) for _ in range(rng.randint(1, longest))] for k in range(n)}


@pytest.mark.parametrize(("piece", "merged"), [(64, 20_000), (1, 1), (2, 3)])
def test_brute_force(spark, monkeypatch, piece, merged):
    monkeypatch.setattr(cv, "PIECE", piece)
    monkeypatch.setattr(cv, "MERGED", merged)
    every = made(150, 5, 3)
    rows = [(k, *r) for k, own in every.items() for r in own]
    got = by_id(cv.report(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == {k: brute(own) for k, own in every.items()}


def test_pieces_join_to_the_whole(spark, monkeypatch):
    """A long conversation in pieces of many sizes has one report."""
    rng = random.Random(5)
    rows = [(None if k % 3 else 7, k // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b?", "c", " ", f"{k}!"])) for k in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = None
    for piece in (1000, 64, 7):
        monkeypatch.setattr(cv, "PIECE", piece)
        got = by_id(cv.report(frame))
        assert set(got) == {None, 7}
        want = want or got
        assert got == want


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "Yes."), (1, 5, "assistant", "cut"), (2, 0, "system", "S."), (3, None, "user", "One."), (3, 0, "user", "Two.")]
    got = cv.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "seq").collect()
    report = by_id(cv.report(spark.createDataFrame(rows, SCHEMA)))
    for k in (1, 2, 3):
        own = [r for r in got if r.conv_id == k]
        assert report[k][-1] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest()
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in own)) and [r.seq for r in own] == list(range(len(own)))
    assert [(r.edit, r.turn, r.role, r.text) for r in got if r.conv_id == 3] == [("K", None, "user", "One."), ("R", 0, "assistant", "Two.")]
    assert report[2] == (0, 0, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    """Each fault falls where the checksum says; a conversation that loses all rows is still reported."""
    rows = [(k, t, None if t == 3 else "assistant", None if t == 2 else f"a.b? {k}!") for k in (*range(40), None) for t in (0, 1, 2, 3, None)]
    rows += [(k, 0, "user", "alone.") for k in range(1000, 1060)]
    want = {}
    for k, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fault == 4 else " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want.setdefault(k, []).extend([(t, role, text)] * {0: 0, 3: 2}.get(fault, 1))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = by_id(cv.report(cv.damaged(frame), F.col("live")))
    assert set(got) == set(want)
    assert any(not own for own in want.values())
    for k, own in want.items():
        assert got[k] == (brute(own, most_inserts=1) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), k


def test_long_texts_other_columns_and_empty_table(spark):
    long = "w " * 1_000_000 + "end."
    wide = spark.createDataFrame([("x", 1, "user", long, 1, 2), ("x", 2, "assistant", long, 1, 2), ("x", -(2**63), "user", long + "!", 1, 2), ("x", 2**63 - 1, "user", "t.", 1, 2)], "conv_id string, turn long, role string, text string, `a.b` int, audit int")
    (r,) = cv.report(wide).collect()
    assert (r.conv_id, r.gaps, r.audit) == ("x", 2**63 - 1, "KRRR")
    named = spark.createDataFrame([(1, 1, "user", "a.")], "`c.id` long, `t.n` long, `r.o` string, `t``x` string")
    assert cv.report(named, None, "c.id", "t.n", "r.o", "t``x").first().audit == "D"
    none = spark.createDataFrame([], SCHEMA)
    assert cv.report(none).count() == 0 and cv.repair(none).count() == 0
