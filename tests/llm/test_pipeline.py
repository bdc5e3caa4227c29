from __future__ import annotations

import corpus_pipeline as cp
from conftest import SF_DIR


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near dedup", "decontamination", "mix sources", "shard"]
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, SF_DIR).cache()
        assert after.columns == columns, name
        if name != "mix sources":
            assert after.count() == after.select("doc_id").distinct().count()
            assert 0 < after.count() <= before.count()
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    out = cp.STAGES[-1][1](spark, before, SF_DIR)
    assert out.count() == before.count()


def test_run(spark):
    out = cp.run(spark, SF_DIR)
    assert set(out.columns) >= {"doc_id", "shard", "slot"}
    assert out.count() > 0


def test_empty_and_odd(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], kinds)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "w" * 200000, "en", "s", 1), (2, "w" * 200000, "en", "s", 1), (3, " ".join(f"a{k}" for k in range(400)), "en", None, 5)], kinds)
    for docs in (none, odd):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
