from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_DIR, same_rows

from strandlake.llm import url_filter as uf


def test_query_equals_sql(spark, duck):
    df = uf.query(spark, SF_DIR)
    rel = duck.sql(uf.SQL)
    same_rows((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall()))


def test_cascade_is_exact(spark):
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(-(2**62), 2**62, 30000))
    listed = rng.random(len(keys)) < 0.05
    other = rng.integers(-(2**62), 2**62, len(keys))
    frame = spark.createDataFrame(list(zip(keys.tolist(), other.tolist(), listed.tolist(), strict=True)), "a long, b long, listed boolean")
    levels = uf.cascade(frame)
    assert len(levels) > 2
    assert (uf.listed_in(levels, keys, other) == listed).all()


@pytest.mark.parametrize("part_keys", [3, 1000])
def test_verdicts(spark, monkeypatch, part_keys):
    monkeypatch.setattr(uf, "PART_KEYS", part_keys)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Spam.Example/x?y", "https://spam.example", "https://notspam.example/", "x://b.com/en/9", "x://EXAMPLE.com/en/77#z", "x://example.net/de/8", "x://a.example.net/de/81?q", "x://y.net/de/1", "x://z.org/es", "x://z.org/es/", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    listed = spark.createDataFrame([(x,) for x in ("spam.example", "unused.org", "z.org", "q1.io", "q2.io", None, "")], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, listed).collect()}
    assert [got[k] for k in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("a.spam.example", "/x", None, "block"), ("spam.example", "", None, "block"), ("notspam.example", "/", None, "allow"),
        ("b.com", "/en/9", "com/en/", "block"), ("example.com", "/en/77", "example.com/en/7", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"),
        ("a.example.net", "/de/81", "example.net/de/8", "block"), ("y.net", "/de/1", "net/de/", "allow"), ("z.org", "/es", None, "block"), ("z.org", "/es/", "org/es/", "block"), ("b:", "//c/d", None, "allow"),
    ]


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    keys = spark.createDataFrame([], "key string")
    assert uf.judge(none, keys).count() == 0
    one = spark.createDataFrame([(1, "x://a.b/c")], "page_id long, url string")
    assert uf.judge(one, keys).first().verdict == "allow"
