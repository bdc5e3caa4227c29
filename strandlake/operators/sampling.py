"""Repeatable sampling and splits: rows are ordered by a hash of a seed and their keys, so every run takes the same ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstats import first_by


def hash_order(seed: int, *keys: str) -> Column:
    """A text that orders rows at random, the same in every engine that knows md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def sample_rows(rows: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, or all."""
    return first_by(rows, n, hash_order(seed, *keys), keys)


def sample_strata(rows: DataFrame, by: Sequence[str], keys: Sequence[str], n: int | None = None, share: float = 1.0, least: int = 0, most: int | None = None, seed: int = 42) -> DataFrame:
    """From each stratum n rows, or a share of them that is at least `least` and at most `most`."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(hash_order(seed, *keys), *keys))
    quota = F.lit(n) if n is not None else F.greatest(F.floor(F.count("*").over(w) * share), F.lit(least))
    if most is not None:
        quota = F.least(quota, F.lit(most))
    return rows.withColumns({"stratum_rank": rank, "stratum_quota": quota}).filter("stratum_rank <= stratum_quota").drop("stratum_rank", "stratum_quota")


def sample_groups(rows: DataFrame, group: str, most: int, seed: int = 42, slack: float = 1.0) -> DataFrame:
    """Rows of whole groups, in random order of the groups, while their number stays at most slack * most; null groups go.

    The running sum is over one row a group.
    """
    sizes = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"))
    order = Window.orderBy(hash_order(seed, group), group)
    fits = sizes.withColumn("rows_so_far", F.sum("n_rows").over(order)).filter(F.col("rows_so_far") <= most * slack)
    return rows.join(fits.select(group), group, "left_semi")


def thin_negatives(rows: DataFrame, by: Sequence[str], keys: Sequence[str], pred_type: str = "pred_type", at: str = "position", hard: float = 0.1, radius: int = 50, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """All rows but TN, hard TN (score from `hard`), TN near another type, and of the easy TN exactly `ratio` times as many as there are others, or all."""
    near = F.count_if(F.col(pred_type) != "TN").over(Window.partitionBy(*by).orderBy(at).rangeBetween(-radius, radius)) > 0
    easy = (F.col(pred_type) == "TN") & (F.greatest("donor_score", "acceptor_score") < hard)
    rows = rows.withColumn("is_easy", easy & ~near)
    others = rows.filter(F.col(pred_type) != "TN").count()
    easy_rows = first_by(rows.filter("is_easy"), int(ratio * others), hash_order(seed, *keys), keys)
    return rows.filter(~F.col("is_easy")).unionByName(easy_rows).drop("is_easy")


def fold_of(group: str, folds: int, seed: int = 42) -> Column:
    """The fold of a group, 0 to folds - 1."""
    return F.pmod(F.conv(F.substring(hash_order(seed, group), 1, 8), 16, 10).cast("long"), F.lit(folds))


def chromosome_split(chrom: Column, validation: Sequence[str] = ("5", "10"), test: Sequence[str] = ("1", "X")) -> Column:
    """train, val or test by chromosome."""
    return F.when(chrom.isin(*test), "test").when(chrom.isin(*validation), "val").otherwise("train")


def leave_out_folds(rows: DataFrame, chrom: str, group: str, groups: Sequence[Sequence[str]], validation: float = 0.15, seed: int = 42) -> DataFrame:
    """rows once for each fold with `fold` and `role`: a fold's chromosomes are its test rows, the others train or validate.

    Validation takes whole groups (genes) by a hash, in the share of all rows that `validation` says, 0.4 of the others at
    most. The folds are few and named; a row is repeated for each of them without a join.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(chrom).cast("string")).agg(F.count("*")).collect()}  # one row a chromosome
    total = sum(sizes.values())
    folds = []
    for names in groups:
        test = sum(sizes.get(n, 0) for n in names) / max(1, total)
        share = 0.0 if test >= 0.99 else min(validation / max(0.01, 1 - test), 0.4)
        place = F.conv(F.substring(hash_order(seed, group), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        role = F.when(F.col(chrom).cast("string").isin(*names), "test").when(place < share, "valid").otherwise("train")
        if test > 0:
            folds.append(F.struct(F.lit(",".join(names)).alias("fold"), role.alias("role")))
    return rows.select("*", F.explode(F.array(*folds)).alias("x")).select(*rows.columns, "x.fold", "x.role")


def pack_small(sizes: dict[str, int], least: int) -> list[list[str]]:
    """Groups of keys: those from `least` rows on stand alone, smaller ones are packed, in order of size, up to that many."""
    out, open_, n = [], [], 0
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if size >= least:
            out.append([key])
        else:
            open_.append(key)
            n += size
            if n >= least:
                out.append(open_)
                open_, n = [], 0
    if open_:
        if out:
            out[-1] = out[-1] + open_
        else:
            out.append(open_)
    return out
