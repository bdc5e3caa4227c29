"""Splice sites, junctions, and patterns of changed sites."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import for_each_group


def exon_sites(exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """Sites of transcripts with two exons or more: (transcript, strand, site_type, position, exon_rank).

    On + the acceptor is the base before an exon's start (not of the first one) and the donor the base after its end (not
    of the last one); on - they are mirrored.
    """
    w = Window.partitionBy(transcript)
    rank = F.when(F.col("strand") == "+", F.row_number().over(w.orderBy("start", "end"))).otherwise(F.row_number().over(w.orderBy(F.col("start").desc(), F.col("end").desc())))
    exons = exons.withColumns({"exon_rank": rank.cast("long"), "n_exons": F.count("*").over(w)}).filter("n_exons >= 2")
    plus = F.col("strand") == "+"
    acceptor = F.when(F.col("exon_rank") > 1, F.struct(F.lit("acceptor").alias("site_type"), F.when(plus, F.col("start") - 1).otherwise(F.col("end") + 1).alias("position")))
    donor = F.when(F.col("exon_rank") < F.col("n_exons"), F.struct(F.lit("donor").alias("site_type"), F.when(plus, F.col("end") + 1).otherwise(F.col("start") - 1).alias("position")))
    return exons.select(transcript, "strand", "exon_rank", F.explode(F.array_compact(F.array(acceptor, donor))).alias("s")).select(transcript, "strand", "s.site_type", "s.position", "exon_rank")


def all_junctions(sites: DataFrame, keys: Sequence[str], most_intron: int | None = None) -> DataFrame:
    """Every donor with every later acceptor of the same keys: (keys, donor_pos, acceptor_pos, intron_length).

    With most_intron only acceptors at most that far away: pairs then meet in bins of that length, not by the keys alone.
    """
    donors = sites.filter("site_type = 'donor'").select(*keys, F.col("position").alias("donor_pos"))
    acceptors = sites.filter("site_type = 'acceptor'").select(*keys, F.col("position").alias("acceptor_pos"))
    if most_intron is not None:
        bin_of = lambda c: F.floor(F.col(c) / most_intron)
        donors = donors.withColumn("bin", F.explode(F.array(bin_of("donor_pos"), bin_of("donor_pos") + 1)))
        pairs = donors.join(acceptors.withColumn("bin", bin_of("acceptor_pos")), [*keys, "bin"]).drop("bin").filter(F.col("acceptor_pos") - F.col("donor_pos") <= most_intron)
    else:
        pairs = donors.join(acceptors, list(keys))
    return pairs.filter("donor_pos < acceptor_pos").withColumn("intron_length", F.col("acceptor_pos") - F.col("donor_pos"))


def best_acceptors(sites: DataFrame, by: Sequence[str], k: int = 3, least: float = 0.0, top: int | None = None) -> DataFrame:
    """For each donor the best of its k nearest later acceptors by mean probability, the closest of equal ones.

    With `top`, only that many donors and acceptors of each group, by probability, take part.
    """
    if top is not None:
        rank = F.row_number().over(Window.partitionBy(*by, "site_type").orderBy(F.col("score").desc(), "position"))
        sites = sites.withColumn("r", rank).filter(F.col("r") <= top).drop("r")
    # An acceptor's number in its group tells which ones come after a donor: those numbered from `passed` on.
    w = Window.partitionBy(*by).orderBy("position")
    is_acceptor = (F.col("site_type") == "acceptor").cast("long")
    numbered = sites.withColumn("passed", F.sum(is_acceptor).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    acceptors = sites.filter("site_type = 'acceptor'").select(*by, (F.row_number().over(w) - 1).cast("long").alias("number"), F.col("position").alias("acceptor_pos"), F.col("score").alias("acceptor_score"))
    donors = numbered.filter("site_type = 'donor'").select(*by, "position", "score", F.explode(F.sequence(F.col("passed"), F.col("passed") + k - 1)).alias("number"))
    met = donors.join(acceptors, [*by, "number"])
    best = F.max(F.struct(((F.col("score") + F.col("acceptor_score")) / 2).alias("mean"), (-F.col("acceptor_pos")).alias("minus"))).alias("best")
    out = met.groupBy(*by, "position").agg(best).filter(F.col("best.mean") > least)
    return out.select(*by, F.col("position").alias("donor_pos"), (-F.col("best.minus")).alias("acceptor_pos"), F.col("best.mean").alias("mean_score"))


def _pair_up(rows: list[tuple[str, int, float]]) -> list[tuple[int, int]]:
    """(donor, acceptor) of (site_type, position, score): donors by falling score take the nearest later free acceptor."""
    donors = sorted((-score, at) for kind, at, score in rows if kind == "donor")
    free = sorted(at for kind, at, _ in rows if kind == "acceptor")
    out = []
    for _, p in donors:
        k = bisect_right(free, p)
        if k < len(free):
            out.append((p, free.pop(k)))
    return out


def greedy_junctions(sites: DataFrame, by: Sequence[str], least: float = 0.0) -> DataFrame:
    """Donors by falling probability take the nearest later acceptor that is still free.

    The choice depends on all earlier ones of a gene, so a gene's sites above `least`, which are few, go to one function.
    """
    return for_each_group(sites.filter(F.col("score") >= least), by, ["site_type", "position", "score"], ["position"], "donor_pos long, acceptor_pos long", _pair_up)


def delta_sites(rows: DataFrame, threshold: float = 0.2, high: float = 0.8, middle: float = 0.5) -> DataFrame:
    """Up to four rows for each variant, one for each delta score from the threshold on, with position, type and category."""
    kinds = (("AG", "acceptor", "gain"), ("AL", "acceptor", "loss"), ("DG", "donor", "gain"), ("DL", "donor", "loss"))
    each = F.array(*(F.struct(F.lit(site).alias("site_type"), F.lit(event).alias("event"), F.col(f"DS_{k}").alias("delta_score"), (F.col("POS") + F.col(f"DP_{k}")).alias("position")) for k, site, event in kinds))
    out = rows.select("CHROM", "POS", F.explode(each).alias("x")).select("CHROM", "POS", "x.*").filter(F.col("delta_score") >= threshold)
    return out.withColumn("category", F.when(F.col("delta_score") >= high, "high").when(F.col("delta_score") >= middle, "moderate").otherwise("low"))


def nearest_of(rows: DataFrame, by: Sequence[str], mark: Column, at: str = "position") -> DataFrame:
    """rows with nearest_marked: the closest position of the group where mark holds (the lower of two), itself included."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = F.when(mark, F.col(at))
    below = F.max(marked).over(w.rangeBetween(Window.unboundedPreceding, 0))
    above = F.min(marked).over(Window.partitionBy(*by).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("nearest_marked", F.when(above.isNull() | (F.col(at) - below <= above - F.col(at)), below).otherwise(above))


def clusters(sites: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """(group, cluster, n, first, last): components of sites that are linked over at most `reach` bases.

    On a line such components are runs without a larger gap, so no graph is needed.
    """
    w = Window.partitionBy(*by).orderBy("position")
    fresh = F.coalesce((F.col("position") - F.lag("position").over(w) > reach).cast("long"), F.lit(1).cast("long"))
    s = sites.withColumn("fresh", fresh)
    s = s.withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


def score_batches(rows: DataFrame, model, columns: Sequence[str], schema: str) -> DataFrame:
    """rows through an opaque model: model(frame of columns) gives a frame of the schema, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return rows.select(*columns).mapInPandas(run, schema)


def junctions_to_number(sites: DataFrame, by: Sequence[str], target: str, first: float = 0.7, step: float = 0.02, rounds: int = 50) -> DataFrame:
    """greedy_junctions at the threshold, moved by steps from `first`, that gives each group the number in column `target`.

    The search is a loop over one gene's sites, so a gene goes to one function.
    """

    def search(rows: list[tuple]) -> list[tuple[int, int]]:
        wanted, threshold = int(rows[0][3]), first

        def at(least: float) -> list[tuple[int, int]]:
            return _pair_up([r[:3] for r in rows if r[2] >= least])

        best = at(threshold)
        for _ in range(rounds):
            if len(best) == wanted or not 0 <= threshold <= 1:
                break
            threshold += step if len(best) > wanted else -step
            trial = at(threshold)
            if abs(len(trial) - wanted) > abs(len(best) - wanted):
                break
            best = trial
        return best

    return for_each_group(sites, by, ["site_type", "position", "score", target], ["position"], "donor_pos long, acceptor_pos long", search)
