"""Predictions against annotated sites: which are true, false, or missed."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of rows that `matched` reads.
SITE, POSITIVE, NEGATIVE = range(3)


#: Rows of a task: there are as many tasks as the scores have of these, so that a task sorts no more when a table grows.
TASK_ROWS = 1 << 18


def tasks_for(rows: DataFrame) -> int:
    """The number of tasks that `rows` are dealt to by their key."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def _called(rows: DataFrame, key: str, key_type: str, window: int, tasks: int) -> DataFrame:
    """(key, position, pred_type, true_position, previous) of true sites and positives; previous is the positive before a positive."""
    when = F.when(F.col("kind") == SITE, F.col("position") - window).otherwise(F.col("position"))
    rows = rows.select(key, "position", "kind", when.alias("when"))
    rows = rows.repartition(tasks, F.col(key)).sortWithinPartitions(key, "when", "kind", "position").select(key, "position", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: deque[int] = deque()
        current: object = free  # no key's value
        previous: int | None = None
        for batch in batches:
            out: list[tuple] = []
            for k, p, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != current:
                    out += [(current, t, "FN", t, None) for t in free]
                    free.clear()
                    current, previous = k, None
                if kind == SITE:
                    free.append(p)
                    continue
                while free and free[0] < p - window:
                    t = free.popleft()
                    out.append((k, t, "FN", t, None))
                out.append((k, p, "TP", free.popleft(), previous) if free else (k, p, "FP", None, previous))
                previous = p
            of = batch.schema.field(0).type
            yield table(out, of)
        if free:
            yield table([(current, t, "FN", t, None) for t in free], of)

    def table(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (of, pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "position", "pred_type", "true_position", "previous"])

    return rows.mapInArrow(scan, f"{key} {key_type}, position long, pred_type string, true_position long, previous long")


def _swept(rows: DataFrame, key: str, key_type: str, window: int, tasks: int, gaps: bool = False) -> DataFrame:
    """(key, position, pred_type, true_position) of `matched`, with n_other and n_true, how many of the key's rows are no
    negatives and have a true position, and with gaps the distance of the nearest positive.

    Marks lie among the rows in their order: where a true position begins to be free, how far it is, and at each positive
    (before all for the first one) which comes next. So one order by position tells which negatives are true and how far
    positives are, by running maxima.
    """
    negatives = rows.filter(F.col("kind") == NEGATIVE).select(key, "position", F.lit("TN").alias("pred_type"))
    called = _called(rows.filter(F.col("kind") != NEGATIVE), key, key_type, window, tasks)
    position, true, none = F.col("position"), F.col("true_position"), F.lit(None).cast("long")
    positive = F.col("pred_type") != "FN"
    last = F.when(F.col("pred_type") == "TP", F.least(true + window, position - 1)).otherwise(true + window)

    def mark(at: Column, pred_type: Column, true_position: Column, held: Column, below: Column, above: Column) -> Column:
        return F.struct(at.alias("position"), pred_type.alias("pred_type"), true_position.alias("true_position"), held.alias("held"), below.alias("below"), above.alias("above"))

    marks = [mark(position, F.col("pred_type"), true, none, F.when(positive, position), none), mark(F.when(true - window <= last, true - window), F.lit(None), none, last, none, none)]
    if gaps:
        marks.append(mark(F.when(positive, F.coalesce("previous", F.lit(-(1 << 63)))), F.lit(None), none, none, none, position))
    marked = called.select(key, F.explode(F.array(*marks)).alias("of")).select(key, "of.*").filter("position is not null")
    dealt = marked.unionByName(negatives, allowMissingColumns=True).repartition(tasks, F.col(key))
    along = Window.partitionBy(key).orderBy("position")
    so_far, whole = along.rangeBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = {"held": F.max("held").over(so_far), "n_other": F.count(F.when(F.col("pred_type") != "TN", 1)).over(whole), "n_true": F.count("true_position").over(whole)}
    if gaps:
        told |= {"below": F.max("below").over(so_far), "above": F.max("above").over(so_far)}
    told_rows = dealt.select(key, "position", "pred_type", "true_position", *(c.alias(name) for name, c in told.items()))
    is_tn = F.col("pred_type") == "TN"
    found = told_rows.filter(F.col("pred_type").isNotNull() & (~is_tn | F.col("held").isNull() | (F.col("held") < position)))
    gap = [F.when(is_tn, F.least(position - F.col("below"), F.when(F.col("above") > position, F.col("above") - position))).alias("gap")] if gaps else []
    return found.select(key, "position", "pred_type", "true_position", "n_other", "n_true", *gap)


def matched(rows: DataFrame, key: str, key_type: str, window: int) -> DataFrame:
    """(key, position, pred_type, true_position) of (key, position, kind): true sites, positives and negatives of each key.

    Positives are taken in ascending order; each one takes the lowest free true position within the window (TP), or is a
    false one (FP). A negative is true (TN) unless a true position within the window is free as it is passed; then it is
    nothing. True positions that are left are missed (FN). As positives ascend, a true position that lies a window before
    one is never wanted again. So positives and true positions, one of these coming up as soon as a positive may take it, are
    read once in their order; what is kept of a key are the true positions of the last two windows. Negatives stay out of
    that: a true position is free from a window before it until it is taken, so the places where it makes a negative nothing
    are known.
    """
    return _swept(rows, key, key_type, window, tasks_for(rows)).select(key, "position", "pred_type", "true_position")


#: How true negatives are chosen where there are more than wanted.
RANDOM, PROXIMITY, WINDOW = "random", "proximity", "window"


def evaluate(scores: DataFrame, sites: DataFrame, key: str, key_type: str, score: str, threshold: float = 0.5, window: int = 2, tn_factor: float | None = None, seed: int = 42, tn_mode: str = RANDOM, tn_radius: int = 50, tasks: int | None = None) -> DataFrame:
    """All prediction types of (key, position, score) against sites (key, position); groups without a site have none.

    A negative within the window of a site that no prediction has taken is neither TN nor anything else. With tn_factor,
    a group has at most that many times its other rows as TN: by a hash of their position (RANDOM), those nearest to a
    positive (PROXIMITY), or by hash among those within tn_radius of one (WINDOW). Groups without a positive go by hash.
    Rows without a score don't count. The keys are dealt to `tasks` tasks, or as many as the counted scores want.
    """
    if tn_mode not in (RANDOM, PROXIMITY, WINDOW):
        raise ValueError(f"no such mode: {tn_mode}")
    tasks = tasks or tasks_for(scores)
    known = sites.select(key, "position").filter(F.col(key).isNotNull()).repartition(tasks, F.col(key)).distinct()
    scored = scores.filter(F.col(score).isNotNull() & F.col(key).isNotNull())
    rows = scored.select(key, "position", F.when(F.col(score) >= threshold, POSITIVE).otherwise(NEGATIVE).alias("kind")).unionByName(known.select(key, "position", F.lit(SITE).alias("kind")))
    gaps = tn_factor is not None and tn_mode != RANDOM
    # Each site is in a row of its own, taken or missed.
    called = _swept(rows, key, key_type, window, tasks, gaps).filter("n_true > 0")
    if tn_factor is None:
        return called.select(key, "position", "pred_type", "true_position")
    is_tn, wanted = F.col("pred_type") == "TN", F.floor(F.col("n_other") * tn_factor)
    hashed = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("position").cast("string"))), F.col("position")]
    outside = F.coalesce(F.col("gap") > tn_radius, F.lit(False))
    order = {RANDOM: hashed, PROXIMITY: [F.col("gap"), *(F.when(F.col("gap").isNull(), x) for x in hashed), F.col("position")], WINDOW: [outside, *hashed]}[tn_mode]
    by = Window.partitionBy(key, is_tn).orderBy(*order)
    kept = F.row_number().over(by) <= wanted
    if tn_mode == WINDOW:  # where all fit, all stay; else none of those outside
        kept &= ~outside | (F.count("*").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) <= wanted)
    return called.withColumn("kept", ~is_tn | kept).filter("kept").select(key, "position", "pred_type", "true_position")


def evaluate_sites(scores: DataFrame, sites: DataFrame, key: str, key_type: str, columns: dict[str, str], **options: object) -> DataFrame:
    """evaluate for each site type, whose score column `columns` tells, with a column site_type; sites has (key, position, site_type)."""
    options = {"tasks": tasks_for(scores)} | options
    each = [evaluate(scores, sites.filter(F.col("site_type") == kind), key, key_type, score, **options).withColumn("site_type", F.lit(kind)) for kind, score in columns.items()]
    return reduce(DataFrame.unionByName, each)


def error_windows(rows: DataFrame, length: Column, before: int = 500, after: int = 500) -> DataFrame:
    """FP and FN with a window around them, cut at the gene's ends."""
    wrong = rows.filter(F.col("pred_type").isin("FP", "FN"))
    return wrong.withColumns({"window_start": F.greatest(F.lit(0), F.col("position") - before), "window_end": F.least(length, F.col("position") + after)})


def best_shift(scores: DataFrame, by: Sequence[str], score: str, label: Column, threshold: float, shifts: Sequence[int], gain: float = 0.0, over: Sequence[str] = ()) -> DataFrame:
    """(over, shift, f1) of the row shift whose F1 is largest, 0 unless another one is better by more than gain.

    All shifts are counted in one pass: each is a window column of the same sorted groups. With `over`, each of its values
    has a shift of its own.
    """
    w = Window.partitionBy(*by).orderBy("position")
    hits = {f"h{k}": F.lag(score, s, 0.0).over(w) >= threshold if s > 0 else F.lead(score, -s, 0.0).over(w) >= threshold if s < 0 else F.col(score) >= threshold for k, s in enumerate(shifts)}
    marked = scores.withColumns({**hits, "is_site": label})
    counts = []
    for k in range(len(shifts)):
        h = F.col(f"h{k}")
        counts += [F.count_if(h & F.col("is_site")).alias(f"tp{k}"), F.count_if(h & ~F.col("is_site")).alias(f"fp{k}"), F.count_if(~h & F.col("is_site")).alias(f"fn{k}")]
    each = marked.groupBy(*over).agg(*counts)
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"tp{k}"), 2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}")), F.lit(0.0)) for k in range(len(shifts))]
    best = F.array_max(F.array(*(F.struct(f.alias("f1"), F.lit(-k).alias("order"), F.lit(s).alias("shift")) for k, (f, s) in enumerate(zip(f1, shifts, strict=True)))))
    zero = f1[list(shifts).index(0)]
    picked = each.select(*over, best.alias("b"), zero.alias("z"))
    better = F.col("b.f1") > F.col("z") + gain
    return picked.select(*over, F.when(better, F.col("b.shift")).otherwise(0).cast("long").alias("shift"), F.when(better, F.col("b.f1")).otherwise(F.col("z")).alias("f1"))


def shift_grid(scores: DataFrame, by: Sequence[str], columns: dict[str, str], kind: str, threshold: float, shifts: Sequence[int], over: Sequence[str] = ("strand",), gain: float = 0.0) -> DataFrame:
    """(over, site_type, shift, f1): best_shift for each value of `over` and each site type, whose score column `columns` tells, in one plan.

    kind is the column of the true site type, null where there is none.
    """
    types = F.explode(F.array(*(F.struct(F.lit(t).alias("site_type"), F.col(c).alias("shifted_score")) for t, c in columns.items())))
    each = scores.select("*", types.alias("of")).select(*(c for c in scores.columns if c != "site_type"), "of.site_type", "of.shifted_score")
    label = F.coalesce(F.col(kind) == F.col("site_type"), F.lit(False))
    return best_shift(each, [*by, *over, "site_type"], "shifted_score", label, threshold, shifts, gain, [*over, "site_type"])
