"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding of `documents`, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import base, decontaminate, mixing, quality, sharding, similar_texts


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of so many bytes, which executors hold beside their heap; a batch of 10,000 long texts is tens of MB, twice."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio; its corpus is this stage's input.

    Null and empty texts fail; each row is judged by its text, repeated ones alike, a null id being never trusted. An empty
    table stays empty; columns may have any names.
    """
    _small_batches(spark)
    return quality.drop_low_quality(docs, base.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word similarity of 0.8 or more): the smallest id, null ids last.

    Of equal ids the smaller hash of the text stays, of equal texts the row that is smaller as JSON. Null and empty texts are
    copies of each other. Rows that share an id, or have none, are told apart by their texts. An empty table stays empty;
    columns may have any names.
    """
    _small_batches(spark)
    return similar_texts.drop_similar_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item.

    Null and empty texts and items copy nothing; rows are judged one by one, whatever their ids. Empty tables change nothing;
    columns may have any names.
    """
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is one of its own. Rows of equal id and source, null ids included, are taken equally often; null and empty
    texts have size 0 and stay once. An empty table stays empty; columns may have any names.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; the shard files hold all columns.

    Every row has a slot of its own, repeated ones too; a null text has size 1. An empty table has no rows; columns may have
    any names.
    """
    return sharding.reshard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mix sources", mix_sources),
    ("shard", shard),
]

#: None of these stages can be told in SQL: hashed n-gram ratios, components of similar texts, windows' fingerprints and random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again."""
    docs = base.table(spark, sf_dir, "documents")
    folder = f"{base.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
