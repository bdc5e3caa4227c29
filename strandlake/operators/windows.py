"""Window operators: deduplication by priority, neighbours, shifts, sessions, and merged intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which prediction type stays where several meet.
PRIORITY = {"TP": 0, "FN": 1, "FP": 2, "TN": 3}


def _rank(priority: dict[str, int], col: str) -> Column:
    out = F.lit(len(priority))
    for name, k in priority.items():
        out = F.when(F.col(col) == name, k).otherwise(out)
    return out


def by_priority(rows: DataFrame, by: Sequence[str], col: str = "pred_type", priority: dict[str, int] = PRIORITY) -> DataFrame:
    """The rows of the best type of each group; ties stay."""
    best = F.min(_rank(priority, col)).over(Window.partitionBy(*by))
    return rows.withColumn("best_rank", best).filter(F.col("best_rank") == _rank(priority, col)).drop("best_rank")


def resolve_conflicts(rows: DataFrame, mode: str = "genomic", transcript: str = "transcript_id") -> DataFrame:
    """by_priority over genomic, transcript or splice_aware groups; genomic ones also list their transcripts."""
    keys = {"genomic": ["gene_id", "position", "strand"], "transcript": ["gene_id", "position", "strand", transcript], "splice_aware": ["gene_id", "position", "strand", "splice_type"]}[mode]
    kept = by_priority(rows, keys)
    if mode != "genomic":
        return kept
    sets = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(transcript)).alias("all_transcripts"), F.countDistinct(transcript).alias("n_transcripts"))
    return kept.join(sets, keys)


def with_context(rows: DataFrame, by: Sequence[str], score: str, at: str = "position", radius: int = 2, prefix: str = "context_score_", fill: float = 0.0) -> DataFrame:
    """The scores of up to radius rows before (m) and after (p); fill beyond the group's ends."""
    w = Window.partitionBy(*by).orderBy(at)
    before = {f"{prefix}m{k}": F.lag(score, k, fill).over(w) for k in range(radius, 0, -1)}
    after = {f"{prefix}p{k}": F.lead(score, k, fill).over(w) for k in range(1, radius + 1)}
    return rows.withColumns(before | after)


def rolling(rows: DataFrame, by: Sequence[str], col: str, at: str = "position", radius: int = 2) -> DataFrame:
    """Centred mean and deviation over 2 * radius + 1 rows, null where the window is cut."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-radius, radius)
    full = F.count(col).over(w) == 2 * radius + 1
    return rows.withColumns({f"{col}_rolling_mean": F.when(full, F.avg(col).over(w)), f"{col}_rolling_std": F.when(full, F.stddev_samp(col).over(w))})


def read_from(rows: DataFrame, by: Sequence[str], fills: dict[str, float], shift: int, at: str = "position", suffix: str = "_shifted") -> DataFrame:
    """Each score as it stands `shift` rows further on; beyond the ends its fill."""
    w = Window.partitionBy(*by).orderBy(at)
    return rows.withColumns({f"{c}{suffix}": F.lead(c, shift, fill).over(w) for c, fill in fills.items()})


def move_by_strand(rows: DataFrame, by: Sequence[str], score: str, offsets: dict[str, int], at: str = "position", fill: float = 0.0, strand: str = "strand") -> DataFrame:
    """score moved along by offsets[strand] rows (to later rows for positive ones); fill at the ends."""
    w = Window.partitionBy(*by).orderBy(at)
    out: Column = F.col(score)
    for sign, k in offsets.items():
        moved = F.lag(score, k, fill).over(w) if k > 0 else F.lead(score, -k, fill).over(w) if k < 0 else F.col(score)
        out = F.when(F.col(strand) == sign, moved).otherwise(out)
    return rows.withColumn(f"{score}_adjusted", out)


def peaks(rows: DataFrame, by: Sequence[str], score: str, threshold: float, gap: int, at: str = "position") -> DataFrame:
    """Runs of rows at or above a threshold with gaps of at most `gap`: (group, session, first, last, n, peak position and score).

    Of equal scores the first position is the peak.
    """
    w = Window.partitionBy(*by).orderBy(at)
    high = rows.filter(F.col(score) >= threshold)
    start = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(1).cast("long"))
    high = high.withColumn("session_start", start)
    high = high.withColumn("session", F.sum("session_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(at)).alias("p")))
    out = high.groupBy(*by, "session").agg(F.min(at).alias("first_position"), F.max(at).alias("last_position"), F.count("*").alias("n"), best.alias("best"))
    return out.select(*by, "session", "first_position", "last_position", "n", (-F.col("best.p")).alias("peak_position"), F.col("best.s").alias("peak_score"))


def merge_intervals(rows: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The unions of intervals that overlap: (group, start, end, n)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce((F.col(start) > reach).cast("long"), F.lit(1).cast("long")))
    rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def near_flag(rows: DataFrame, by: Sequence[str], mark: Column, radius: int, at: str = "position", name: str = "near_marked") -> DataFrame:
    """Whether a row where `mark` holds lies at most radius away."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-radius, radius)
    return rows.withColumn(name, F.count_if(mark).over(w) > 0)


def gaps_between(rows: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Lengths of the gaps between consecutive intervals of a group, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(start, end)
    rows = rows.withColumns({"next_start": F.lead(start).over(w), "gap_number": F.row_number().over(w).cast("long")})
    return rows.filter(F.col("next_start").isNotNull()).select(*by, "gap_number", (F.col("next_start") - F.col(end) - 1).alias("gap_length"))


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("row_rank", rank).filter(F.col("row_rank") <= n).drop("row_rank")


def largest_with_ties(rows: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """All rows of each group that have its largest value."""
    return rows.withColumn("largest", F.max(col).over(Window.partitionBy(*by))).filter(F.col(col) == F.col("largest")).drop("largest")
