"""Checks as tables of what is wrong, or as shares; none of them prints or raises."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import schema_differences


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, share) of the rows that break each rule, in one pass; a null counts as broken."""
    one = rows.agg(F.count("*").alias("total"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n"), F.try_divide(F.col(name), F.col("total")).alias("share")) for name in rules)))
    return one.select(each.alias("x")).select("x.*")


def missing_keys(wanted: DataFrame, there: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Wanted keys with fewer than `least` rows."""
    enough = there.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return wanted.select(key).distinct().join(enough, key, "left_anti")


def table_report(rows: DataFrame, required: Sequence[str], least_rows: int = 1) -> dict[str, object]:
    """What a table of this kind lacks: columns, or rows (of which no more than needed are counted)."""
    n = rows.limit(least_rows).count()
    return {"missing": [c for c in required if c not in rows.columns], "enough_rows": n >= least_rows}


def feature_drift(train: DataFrame, live: DataFrame, features: Sequence[str], most: float = 3.0) -> DataFrame:
    """(feature, shift, drifted): distance of the means in deviations of the training table."""
    t = train.agg(*(x for f in features for x in (F.avg(f).alias(f"{f}|m"), F.stddev_samp(f).alias(f"{f}|s"))))
    v = live.agg(*(F.avg(f).alias(f"{f}|v") for f in features))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.try_divide(F.col(f"`{f}|v`") - F.col(f"`{f}|m`"), F.col(f"`{f}|s`")).alias("shift")) for f in features)))
    return t.crossJoin(F.broadcast(v)).select(each.alias("x")).select("x.*").withColumn("drifted", F.abs("shift") > most)


def same_features(train: DataFrame, live: DataFrame) -> bool:
    return not any(schema_differences(train, live).values())


def motif_share(sites: DataFrame, windows: str = "window") -> DataFrame:
    """(site_type, n, share): sites whose window holds the type's motif, GT or GC of a donor, AG of an acceptor."""
    has = F.when(F.col("site_type") == "donor", F.col(windows).rlike("GT|GC")).otherwise(F.col(windows).contains("AG"))
    return sites.groupBy("site_type").agg(F.count("*").alias("n"), F.avg(has.cast("double")).alias("share"))


def reference_matches(variants: DataFrame, sequences: DataFrame, key: str, at: str = "pos") -> DataFrame:
    """variants with matches: whether the sequence (1-based) has the reference allele at their position."""
    rows = variants.join(sequences.select(F.col(key).alias("seq_key"), "sequence"), F.col(key) == F.col("seq_key"), "left").drop("seq_key")
    return rows.withColumn("matches", (F.col(at) >= 1) & (F.substring("sequence", F.col(at).cast("int"), F.length("ref")) == F.col("ref"))).drop("sequence")


def overlap_free(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that stand in more than one part."""
    from .joins import common_to

    return common_to(parts, key, 2)


def schema_violations(rows: DataFrame, required: dict[str, str], patterns: dict[str, str] | None = None, least_columns: dict[str, int] | None = None) -> DataFrame:
    """(column, problem): required columns that lack or have another type, columns of a pattern with another type, and patterns with too few columns.

    Types are Spark's names; required ones may be several, joined by a bar. Only the schema is looked at.
    """
    kinds, out = dict(rows.dtypes), []
    for name, wanted in required.items():
        if name not in kinds:
            out.append((name, "missing"))
        elif kinds[name] not in wanted.split("|"):
            out.append((name, f"{kinds[name]} instead of {wanted}"))
    for pattern, wanted in (patterns or {}).items():
        found = [c for c in kinds if re.fullmatch(pattern, c)]
        out += [(c, f"{kinds[c]} instead of {wanted}") for c in found if kinds[c] not in wanted.split("|")]
        if len(found) < (least_columns or {}).get(pattern, 0):
            out.append((pattern, f"{len(found)} columns"))
    return rows.sparkSession.createDataFrame(out, "column string, problem string")
