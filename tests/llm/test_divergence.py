from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from conftest import SF_DIR, same_rows

from strandlake.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """All numbers from whole tables of counts, term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    n, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        n[lang, source].update(terms)
        seen[lang].update(set(terms))
    groups = sorted({(r[1], r[2]) for r in rows})
    out = []
    for lang in sorted({g[0] for g in groups}):
        own = [s for x, s in groups if x == lang]
        kept = [t for t, d in seen[lang].items() if d >= least]

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        all_ = p(sum((n[lang, s] for s in own), Counter()))
        ps = {s: p(n[lang, s]) for s in own}
        for s in own:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, ps[s][t] - all_[t]) for t in kept if n[lang, s][t] and ps[s][t] > all_[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < top]
    return out


def ask(spark, rows, least=2, top=3, schema="text string, lang string, source string"):
    got = dv.divergence(spark.createDataFrame(rows, schema), least_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


def test_query_equals_sql(spark, duck):
    df = dv.query(spark, SF_DIR)
    rel = duck.sql(dv.SQL)
    same_rows((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall()))


ROWS = [
    ("one two Two three", "en", "a"), ("one ONE été É", "en", "b"), ("Été one nine", "en", "b"), (None, "en", "c"), ("", "en", "d"), ("one one", "en", None),
    ("12 34 -- \n\t", "de", "a"), ("alone", "de", "b"), ("ein zwei", None, "a"), ("ein drei", None, None), ("ein zwei", None, "a"), ("w" * 70_000 + " one", "en", "a"),
    ("w" * 70_000 + " two", "en", "a"), ("a\x00b A b", "x", "x"), ("a b", "x", "y"), ("b a　c", "x", "y"),
]


@pytest.mark.parametrize(("least", "top"), [(1, 50), (2, 3), (2, 0), (9, 5)])
def test_brute_force(spark, least, top):
    assert ask(spark, ROWS, least, top) == sorted(brute(ROWS, least, top))


def test_brute_force_in_small_pieces(spark, monkeypatch):
    """Statements over few rows, several shards and repeated flushing change nothing."""
    rows = [(" ".join(f"t{(k * j) % 17}x" .replace("0", "o") + "abcdefg"[(k + j) % 7] for j in range(1, 9)), "en" if k % 3 else "de", f"s{k % 5}") for k in range(80)]
    want = sorted(brute(rows, 3, 4))
    for name, value in (("SLICE_BYTES", 100), ("HELD", 5), ("MERGED", 3), ("SHARD_ROWS", 20)):
        monkeypatch.setattr(dv, name, value)
    assert ask(spark, rows, 3, 4) == want


def test_hot_group_and_repeated_rows(spark):
    rows = [("same words here", "en", "hot")] * 200 + [("same words there", "en", f"s{k}") for k in range(5)]
    assert ask(spark, rows, 3, 9) == sorted(brute(rows, 3, 9))


def test_other_columns_and_empty_table(spark):
    wide = spark.createDataFrame([("one two", "en", "a", 1, "n", "p", 2)] * 2, "text string, lang string, source string, `a.b` int, term string, part string, `x``y` int")
    assert [tuple(r)[:4] for r in dv.divergence(wide, least_docs=1).collect()] == []
    two = wide.unionByName(spark.createDataFrame([("two", "en", "b", 1, "n", "p", 2)], wide.schema))
    assert {tuple(r)[1:4] for r in dv.divergence(two, least_docs=1).collect()} == {("a", "pair", "b"), ("b", "pair", "a"), ("a", "term", "one"), ("b", "term", "two")}
    renamed = spark.createDataFrame([("one", "en", "a")], "`my.text` string, `l` string, `s.s` string")
    assert dv.divergence(renamed, "my.text", "l", "s.s", least_docs=1).count() == 0
    assert dv.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
