"""Splicing patterns of a variant: what changed sites of a gene, taken together, come to.

Sites are (by, position, site_type, delta_score, is_canonical, is_cryptic); one is activated where the score rises and
suppressed where it falls. Neighbours come from windows of one sort, near sites from a band join; only the graph of a gene's
changed sites is put together in one list.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import band_join
from .runs import for_each_group

#: Change of a cryptic site that counts, bases around a site that are near, and exons of a usual size.
THRESHOLD, NEAR = 0.2, 300
LEAST_EXON, MOST_EXON = 50, 5000
EXON_SKIPPING, INTRON_RETENTION, CRYPTIC_ACTIVATION, CRYPTIC_SUPPRESSION, ALTERNATIVE_5SS, ALTERNATIVE_3SS, COMPLEX = "exon_skipping", "intron_retention", "cryptic_activation", "cryptic_suppression", "alternative_5ss", "alternative_3ss", "complex_pattern"
# How much a kind of pattern counts in the ranking.
PRIORITY = ((EXON_SKIPPING, 1.0), (INTRON_RETENTION, 0.9), (CRYPTIC_ACTIVATION, 0.85), (ALTERNATIVE_5SS, 0.8), (ALTERNATIVE_3SS, 0.8), (COMPLEX, 0.7))
OTHER_PRIORITY = 0.5


def _up() -> Column:
    return F.col("delta_score") > 0


def _down() -> Column:
    return F.col("delta_score") < 0


def _severity(deltas: Column) -> Column:
    """Mean of the largest and the mean size of the changes; nulls don't count."""
    sizes = F.transform(F.array_compact(deltas), lambda x: F.abs(x))
    return (F.array_max(sizes) + F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)) / 2


def _trust(severity: Column, more: Column | None = None, factor: float = 1.0) -> Column:
    """Severity up to 1, raised by a factor where `more` holds."""
    base = F.least(severity, F.lit(1.0))
    return base if more is None else F.least(F.when(more, base * factor).otherwise(base), F.lit(1.0))


def _along(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy("position", "site_type")


def _consecutive(sites: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Neighbours of two site types that are both canonical and suppressed, with second_position and second_delta."""
    w = _along(by)
    down = F.col("is_canonical") & _down()
    nexts = sites.withColumns({"second_type": F.lead("site_type").over(w), "second_position": F.lead("position").over(w), "second_delta": F.lead("delta_score").over(w), "second_down": F.lead(down).over(w), "down": down})
    return nexts.filter("down and second_down").filter((F.col("site_type") == first) & (F.col("second_type") == second))


def _before(by: Sequence[str], at: Column, what: Column) -> Column:
    """The last `what` (a struct that begins with the position) of smaller positions."""
    return F.max(what).over(Window.partitionBy(*by).orderBy(at.asc()).rangeBetween(Window.unboundedPreceding, -1))


def _after(by: Sequence[str], at: Column, what: Column) -> Column:
    """The first `what` of larger positions; the frame runs over falling positions, as one to the end would be read anew for each row."""
    return F.min(what).over(Window.partitionBy(*by).orderBy(at.desc()).rangeBetween(Window.unboundedPreceding, -1))


def skipped_exons(sites: DataFrame, by: Sequence[str], least: int = LEAST_EXON, most: int = MOST_EXON) -> DataFrame:
    """(by, exon_start, exon_end, exon_size, upstream_donor, downstream_acceptor, num_sites, severity, confidence).

    A canonical acceptor and the donor next to it, both suppressed, at an exon's distance. The nearest donor before and the
    nearest acceptor after the exon take part if they are activated; of two at a place the one with the smaller change.
    """
    at, own = F.col("position"), F.struct("position", "delta_score")
    donor, acceptor = (F.when(F.col("site_type") == x, own) for x in ("donor", "acceptor"))
    # The flank after the exon is looked for from its donor, the next row, and handed back to the acceptor.
    w = _along(by)
    flanked = sites.withColumns({"up": _before(by, at, donor), "down_own": _after(by, at, acceptor)}).withColumn("flank_after", F.lead("down_own").over(w))
    pairs = _consecutive(flanked, by, "acceptor", "donor")
    up = F.when(F.col("up.delta_score") > 0, F.col("up"))
    after = F.when(F.col("flank_after.delta_score") > 0, F.col("flank_after"))
    deltas = F.array("delta_score", "second_delta", up["delta_score"], after["delta_score"])
    strong = (F.abs("delta_score") > 0.5) & (F.abs("second_delta") > 0.5)
    size = F.col("second_position") - F.col("position")
    out = pairs.filter(size.between(least, most)).withColumn("severity", _severity(deltas))
    return out.select(
        *by, F.col("position").alias("exon_start"), F.col("second_position").alias("exon_end"), size.alias("exon_size"), up["position"].alias("upstream_donor"), after["position"].alias("downstream_acceptor"),
        F.size(F.array_compact(deltas)).cast("long").alias("num_sites"), "severity", _trust(F.col("severity"), strong, 1.2).alias("confidence"),
    )


def retained_introns(sites: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, intron_start, intron_end, intron_size, severity, confidence): a canonical donor and the acceptor next to it, both suppressed."""
    pairs = _consecutive(sites, by, "donor", "acceptor").withColumn("severity", _severity(F.array("delta_score", "second_delta")))
    return pairs.select(*by, F.col("position").alias("intron_start"), F.col("second_position").alias("intron_end"), (F.col("second_position") - F.col("position")).alias("intron_size"), "severity", _trust(F.col("severity")).alias("confidence"))


def alternative_sites(sites: DataFrame, by: Sequence[str], near: int = NEAR) -> DataFrame:
    """(by, pattern_type, canonical_position, alternative_position, shift, severity, confidence): a suppressed canonical site and each activated one of its type nearby."""
    lost = sites.filter(F.col("is_canonical") & _down()).select(*by, "site_type", "position", "delta_score")
    gained = sites.filter(_up()).select(*by, "site_type", "position", "delta_score")
    met = band_join(lost, gained, [*by, "site_type"], near).withColumn("severity", _severity(F.array("delta_score", "delta_score_r")))
    kind = F.when(F.col("site_type") == "donor", ALTERNATIVE_5SS).otherwise(ALTERNATIVE_3SS)
    return met.select(*by, kind.alias("pattern_type"), F.col("position").alias("canonical_position"), F.col("position_r").alias("alternative_position"), (F.col("position_r") - F.col("position")).alias("shift"), "severity", _trust(F.col("severity")).alias("confidence"))


def cryptic_sites(sites: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """(by, pattern_type, cryptic_position, site_type, canonical_position, num_sites, severity, confidence).

    Cryptic sites with so large a change, and the canonical site of their type that is nearest (the lower of two; itself, if
    it is one), null where there is none.
    """
    own = F.when(F.col("is_canonical"), F.struct("position", "delta_score"))
    keys = [*by, "site_type"]
    below = F.max(own).over(Window.partitionBy(*keys).orderBy("position").rangeBetween(Window.unboundedPreceding, 0))
    above = F.min(own).over(Window.partitionBy(*keys).orderBy(F.col("position").desc()).rangeBetween(Window.unboundedPreceding, 0))
    rows = sites.withColumns({"below": below, "above": above}).filter(F.col("is_cryptic") & (F.abs("delta_score") >= threshold))
    lower = F.col("above").isNull() | (F.col("position") - F.col("below.position") <= F.col("above.position") - F.col("position"))
    rows = rows.withColumn("near", F.when(lower, F.col("below")).otherwise(F.col("above")))
    deltas = F.array("delta_score", "near.delta_score")
    rows = rows.withColumn("severity", _severity(deltas))
    trust = F.when(_up(), _trust(F.col("severity"), F.col("delta_score") > 0.8, 1.15)).otherwise(_trust(F.col("severity")))
    kind = F.when(_up(), CRYPTIC_ACTIVATION).otherwise(CRYPTIC_SUPPRESSION)
    return rows.select(*by, kind.alias("pattern_type"), F.col("position").alias("cryptic_position"), "site_type", F.col("near.position").alias("canonical_position"), F.size(F.array_compact(deltas)).cast("long").alias("num_sites"), "severity", trust.alias("confidence"))


def complex_groups(sites: DataFrame, by: Sequence[str], reach: int = 2 * NEAR) -> DataFrame:
    """(by, first_position, last_position, num_sites, activated, suppressed, subtype, severity, confidence).

    Places are linked if sites at them within `reach` are both activated or both suppressed. A component of three places or
    more with two sites of each kind is a pattern. A gene's changed places are linked in runs of each kind, which meet where a
    place has both; one gene's sites are one list.
    """

    def find(rows: list[tuple]) -> list[tuple]:
        root: dict[int, int] = {}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        for sign in (1, -1):
            before = None
            for p, _, delta, *_ in rows:
                if delta * sign > 0:
                    root.setdefault(p, p)
                    if before is not None and p - before <= reach:
                        root[max(top(p), top(before))] = min(top(p), top(before))
                    before = p
        groups: dict[int, list[tuple]] = {}
        for r in rows:
            if r[0] in root:
                groups.setdefault(top(r[0]), []).append(r)
        out = []
        for own in groups.values():
            up, down = (sum(r[2] * sign > 0 for r in own) for sign in (1, -1))
            if len({r[0] for r in own}) >= 3 and up >= 2 and down >= 2:
                donors = sum(r[1] == "donor" for r in own)
                acceptors = sum(r[1] == "acceptor" for r in own)
                mixed = any(r[4] for r in own) and any(r[3] for r in own)
                subtype = "multiple_exon_changes" if donors > 2 and acceptors > 2 else "mixed_canonical_cryptic" if mixed else "unclassified_complex"
                sizes = [abs(r[2]) for r in own]
                severity = (max(sizes) + sum(sizes) / len(sizes)) / 2
                out.append((own[0][0], own[-1][0], len(own), up, down, subtype, severity, min(1.0, severity)))
        return out

    schema = "first_position long, last_position long, num_sites long, activated long, suppressed long, subtype string, severity double, confidence double"
    return for_each_group(sites, by, ["position", "site_type", "delta_score", "is_canonical", "is_cryptic"], ["position", "site_type"], schema, find)


def ranked_patterns(sites: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, pattern_type, first_position, last_position, num_sites, severity, confidence, rank_score) of all patterns."""
    two = F.lit(2).cast("long")

    def of(rows: DataFrame, kind: Column, a: Column, b: Column, n: Column) -> DataFrame:
        return rows.select(*by, kind.alias("pattern_type"), F.least(a, b).alias("first_position"), F.greatest(a, b).alias("last_position"), n.alias("num_sites"), "severity", "confidence")

    c = F.col
    every = [
        of(skipped_exons(sites, by), F.lit(EXON_SKIPPING), c("exon_start"), c("exon_end"), c("num_sites")),
        of(retained_introns(sites, by), F.lit(INTRON_RETENTION), c("intron_start"), c("intron_end"), two),
        of(alternative_sites(sites, by), c("pattern_type"), c("canonical_position"), c("alternative_position"), two),
        of(cryptic_sites(sites, by), c("pattern_type"), c("cryptic_position"), c("cryptic_position"), c("num_sites")),
        of(complex_groups(sites, by), F.lit(COMPLEX), c("first_position"), c("last_position"), c("num_sites")),
    ]
    rows = reduce(DataFrame.unionByName, every)
    priority = F.lit(OTHER_PRIORITY)
    for kind, value in PRIORITY:
        priority = F.when(c("pattern_type") == kind, value).otherwise(priority)
    return rows.withColumn("rank_score", c("confidence") * 0.7 + priority * 0.3)
