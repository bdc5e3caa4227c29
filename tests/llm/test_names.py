"""Columns of any name: dots, blanks, backticks, and the names that operators use inside."""

from __future__ import annotations

import pytest

from strandlake.llm import decontaminate, line_dedup, mixing, near_dedup, quality, sharding, similar_texts, url_filter

ODD = ["a.b", "A b", "x`y", "id", "text_hash", "no_id", "root", "row", "first", "fp", "hits", "copied_items", "quality_verdict", "more", "mix_copy", "n_lines", "removed", "lines", "key", "item_id", "kept", "v", "host.name", "url_listed", "_"]
GOOD = " ".join(f"word{k % 60} number{k % 7}" for k in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    names = ", ".join("`" + n.replace("`", "``") + "` string" for n in ODD)
    rows = [(k, f"{GOOD} tail{k}" if k else "benchmark item of eight words stands here whole", "s", *["v"] * len(ODD)) for k in range(6)]
    rows.append((7, None, None, *[None] * len(ODD)))
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")


def whole(docs, out, n):
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == n
    assert all(tuple(r[3:]) == ("v",) * len(ODD) for r in got if r["doc_id"] != 7)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "Benchmark item of eight words stands here whole")], "item_id long, text string")
    whole(docs, decontaminate.drop_contaminated(docs, items), 6)


def test_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 20)
    items = spark.createDataFrame([(k, f"Benchmark item of eight words stands here whole{'' if k == 1 else k}") for k in range(4)], "item_id long, text string")
    whole(docs, decontaminate.drop_contaminated(docs, items), 6)


@pytest.mark.parametrize("slice_", [1 << 23, 30_000])
def test_quality(spark, docs, monkeypatch, slice_):
    monkeypatch.setattr(quality, "SLICE", slice_)
    whole(docs, quality.drop_low_quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), 5)


def test_near_copies(docs):
    whole(docs, near_dedup.drop_near_copies(docs), 3)


def test_similar_texts(docs):
    whole(docs.unionByName(docs), similar_texts.drop_similar_texts(docs.unionByName(docs)), 3)


def test_lines(docs):
    whole(docs, line_dedup.drop_repeated_lines(docs), 7)


def test_mix(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r["a.b"] for r in out.collect()} == {"v"}  # the null source has no words


def test_shards(docs):
    assert sharding.reshard(docs).count() == 7


def test_urls(spark):
    pages = spark.createDataFrame([(1, "x://q.spam.example/", 5, 6)], "page_id long, url string, url_listed int, `a.b` int")
    got = url_filter.judge(pages, spark.createDataFrame([("spam.example",)], "key string")).first()
    assert (got["verdict"], got["url_listed"], got["a.b"]) == ("block", 5, 6)
