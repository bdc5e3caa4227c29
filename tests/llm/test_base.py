from __future__ import annotations

import random

import numpy as np
import pytest

from strandlake.llm import base


def test_span_hashes_tell_spans_apart():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 200]))) for _ in range(600)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    names: dict[bytes, int] = {}
    for t, h in zip(texts, base.span_hashes(raw, starts, ends).tolist(), strict=True):
        assert names.setdefault(t, h) == h
    assert len(set(names.values())) == len(names)
    # The same bytes elsewhere, in a buffer of another length.
    for pad in range(9):
        more = np.frombuffer(b"x" * pad + texts[5] + b"y" * (pad % 3), np.uint8)
        assert base.span_hashes(more, np.array([pad]), np.array([pad + len(texts[5])]))[0] == names[texts[5]]


def test_names_that_are_not_taken():
    assert base.unused(["a", "B", "b_"], "b", "c", "c") == ["b__", "c", "c_"]


@pytest.mark.parametrize("small", [0, 100])
def test_first_of_each(spark, monkeypatch, small):
    monkeypatch.setattr(base, "if_small", lambda df, most=small: df if df.count() > most else df.hint("broadcast"))
    docs = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (2, "x", "c"), (None, "y", "d"), (None, "z", "e"), (None, "z", "e"), (3, "y", "f")], "doc_id long, text string, n string")
    rows = docs.select(*base.row_key("doc_id", "text"), "text").withColumnRenamed("text", "root")
    got = base.first_of_each(docs, rows, "doc_id", "text")
    assert got.columns == docs.columns
    assert sorted(r.n for r in got.collect()) == ["a", "e", "f"]


def test_clean(spark):
    parked = base.park(spark.range(3))
    assert parked.count() == 3
    base.clean(spark)
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FILE_NOT_EXIST"):
        parked.count()
