"""Metrics of predictions: confusion counts, curves, calibration, top-k, and tests of features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.stats import chi2_tail, normal_tail, student_quantile, student_tail, tail
from .orderstats import quantiles
from .ranks import least_from, running, with_mean_rank

TYPES = ("TP", "FP", "FN", "TN")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column, tn: Column | None = None) -> dict[str, Column]:
    """Precision, recall, F1 and, with true negatives, accuracy and specificity; 0 where a denominator is."""
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    out = {"precision": precision, "recall": recall, "f1_score": _share(2 * tp, 2 * tp + fp + fn)}
    if tn is not None:
        out |= {"accuracy": _share(tp + tn, tp + tn + fp + fn), "specificity": _share(tn, tn + fp)}
    return out


def confusion(rows: DataFrame, by: Sequence[str] = (), pred_type: str = "pred_type") -> DataFrame:
    """Counts of the four types and the rates for each group, in one aggregation."""
    counts = [F.count_if(F.col(pred_type) == t).alias(t) for t in TYPES]
    out = rows.groupBy(*by).agg(*counts)
    return out.withColumns(rates(*(F.col(t) for t in TYPES)))


def micro(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates of summed counts."""
    out = counts.groupBy(*by).agg(*(F.sum(t).alias(t) for t in TYPES))
    return out.withColumns(rates(*(F.col(t) for t in TYPES)))


def curve(rows: DataFrame, label: Column, score: str, digits: int = 6) -> DataFrame:
    """(score, tp, fp, positives, negatives): counts at or above each score; equal scores are one step.

    Scores are rounded to `digits`, so the running sums, which one task makes, have at most 10 ** digits + 1 steps.
    """
    steps = rows.groupBy(F.round(score, digits).alias("score")).agg(F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))
    down = Window.orderBy(F.col("score").desc())
    all_ = Window.partitionBy(F.lit(1))
    return steps.select("score", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(all_).alias("positives"), F.sum("neg").over(all_).alias("negatives"))


def areas(rows: DataFrame, label: Column, score: str) -> DataFrame:
    """(roc_auc, average_precision, pr_auc) in one row: by trapezoids and by steps."""
    c = curve(rows, label, score)
    down = Window.orderBy(F.col("score").desc())
    c = c.withColumns({"tp0": F.lag("tp", 1, 0).over(down), "fp0": F.lag("fp", 1, 0).over(down)})
    p, n = F.max("positives"), F.max("negatives")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.coalesce(F.try_divide(F.col("tp0"), F.col("tp0") + F.col("fp0")), F.lit(1.0))
    return c.agg(
        F.try_divide(F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2), p * n).alias("roc_auc"),
        F.try_divide(F.sum((F.col("tp") - F.col("tp0")) * precision), p).alias("average_precision"),
        F.try_divide(F.sum((F.col("tp") - F.col("tp0")) * (precision + before) / 2), p).alias("pr_auc"),
    )


def calibration(rows: DataFrame, label: Column, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) for bins (lower, upper] of the score; 0 lies in none."""
    bucket = F.ceil(F.col(score) * bins).cast("long")
    return rows.filter(F.col(score) > 0).groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(label.cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, label: Column, score: str, bins: int = 10) -> DataFrame:
    """(ece) in one row: mean distance of confidence and accuracy, weighted by n over all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return calibration(rows, label, score, bins).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("s")).join(F.broadcast(total)).select((F.col("s") / F.col("total")).alias("ece"))


def threshold_sweep(rows: DataFrame, label: Column, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts and rates at each threshold, from one pass over the rows: a row counts for a range of thresholds."""
    aggs = []
    for k, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.count_if(hit & label).alias(f"TP{k}"), F.count_if(hit & ~label).alias(f"FP{k}"), F.count_if(~hit & label).alias(f"FN{k}"), F.count_if(~hit & ~label).alias(f"TN{k}")]
    one = rows.agg(*aggs)
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{c}{k}").alias(c) for c in TYPES)) for k, t in enumerate(thresholds))))
    out = one.select(each.alias("x")).select("x.*")
    return out.withColumns(rates(*(F.col(t) for t in TYPES)))


def best_threshold(sweep: DataFrame, metric: str = "f1_score") -> DataFrame:
    """The smallest threshold with the largest metric."""
    return sweep.agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.m").alias(metric))


def top_k(rows: DataFrame, by: Sequence[str], label: Column, score: str, ties: Sequence[str]) -> DataFrame:
    """(group, k, hits): of the k best scored rows how many are true, k being the group's number of true rows."""
    w = Window.partitionBy(*by)
    marked = rows.withColumn("is_true", label.cast("long")).withColumn("k", F.sum("is_true").over(w))
    marked = marked.withColumn("place", F.row_number().over(w.orderBy(F.col(score).desc(), *ties)))
    return marked.filter(F.col("k") > 0).groupBy(*by).agg(F.max("k").alias("k"), F.sum(F.when(F.col("place") <= F.col("k"), F.col("is_true")).otherwise(0)).alias("hits"))


def effective_errors(rows: DataFrame, by: Sequence[str], at: str = "position", types: Sequence[str] = ("FP", "FN")) -> DataFrame:
    """Distinct positions in error for each group and type; of several types at a position the first in the given order counts."""
    rank = F.lit(len(types))
    for k, t in reversed(list(enumerate(types))):
        rank = F.when(F.col("pred_type") == t, k).otherwise(rank)
    each = rows.filter(F.col("pred_type").isin(*types)).groupBy(*by, at).agg(F.min(rank).alias("r"))
    counts = each.groupBy(*by).agg(*(F.count_if(F.col("r") == k).alias(t) for k, t in enumerate(types)), F.count("*").alias("total"))
    return counts


def hard_groups(performance: DataFrame, by: Sequence[str], metric: str = "f1_score", error: str = "FP", most: float = 0.5, n: int = 10) -> DataFrame:
    """The n groups with most errors among those whose mean metric is at most `most`."""
    out = performance.groupBy(*by).agg(F.avg(metric).alias(metric), F.sum(error).alias(error))
    return out.filter(F.col(metric) <= most).orderBy(F.col(error).desc(), F.col(metric).asc(), *by).limit(n)


def welch(rows: DataFrame, label: Column, features: Sequence[str]) -> DataFrame:
    """(feature, n1, n0, mean1, mean0, t, df, cohens_d) of each feature between the two label groups."""
    moments = []
    for f in features:
        for k, on in ((1, label), (0, ~label)):
            x = F.when(on, F.col(f))
            moments += [F.count(x).alias(f"{f}|n{k}"), F.avg(x).alias(f"{f}|m{k}"), F.var_samp(x).alias(f"{f}|v{k}")]
    one = rows.agg(*moments)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), *(F.col(f"`{f}|{m}{k}`").alias(f"{m}{k}") for k in (1, 0) for m in "nmv")) for f in features)))
    out = one.select(each.alias("x")).select("x.*")
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return out.select("feature", "n1", "n0", F.col("m1").alias("mean1"), F.col("m0").alias("mean0"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"), F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)).alias("df"), F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("cohens_d"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, chi2, cramers_v, mutual_information) of two categorical columns, in one row."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    by_a, by_b, all_ = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy(F.lit(1))
    cells = cells.withColumns({"ra": F.sum("o").over(by_a), "rb": F.sum("o").over(by_b), "n": F.sum("o").over(all_)})
    e = F.col("ra") * F.col("rb") / F.col("n")
    # Empty cells add their expectation to chi2: n less the expectations of the others.
    out = cells.agg(F.max("n").alias("n"), F.sum((F.col("o") - e) * (F.col("o") - e) / e - e).alias("c"), F.sum(F.col("o") / F.col("n") * F.ln(F.col("o") / e)).alias("mutual_information"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    chi2 = F.col("c") + F.col("n")
    return out.select("n", chi2.alias("chi2"), F.sqrt(F.try_divide(chi2, F.col("n") * (F.least("ka", "kb") - 1))).alias("cramers_v"), "mutual_information")


def benjamini_hochberg(rows: DataFrame, p: str) -> DataFrame:
    """rows with q: the smallest p * n / rank from this rank on, at most 1; a null or invalid p counts as 1.

    Equal p share the last one's rank, so that only the different p are put in order.
    """
    clean = F.when((F.col(p) >= 0) & (F.col(p) <= 1), F.col(p)).otherwise(1.0)
    rows = rows.withColumn("p_clean", clean)
    counts = rows.groupBy("p_clean").agg(F.count("*").alias("p_n"))
    total = counts.agg(F.sum("p_n").alias("p_total"))
    ranked = running(counts, "p_clean", "p_n").join(F.broadcast(total))
    ranked = ranked.withColumn("p_scaled", F.col("p_clean") * F.col("p_total") / (F.col("before") + F.col("p_n")))
    q = least_from(ranked, "p_clean", "p_scaled", "q").select("p_clean", F.least("q", F.lit(1.0)).alias("q"))
    return rows.join(q, "p_clean").drop("p_clean")


def describe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, nulls, distinct, min, max, mean, std, p25, p50, p75) of numeric columns."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|n"), F.count_if(x.isNull()).alias(f"{c}|nulls"), F.countDistinct(x).alias(f"{c}|distinct"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max"), F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std")]
    exact = quantiles(rows, {c: F.col(c).cast("double") for c in columns}, (0.25, 0.5, 0.75))
    parts = ("n", "nulls", "distinct", "min", "max", "mean", "std", "p25", "p50", "p75")
    known = {f"{c}|{k}": F.lit(x).cast("double") for c, values in exact.items() for k, x in zip(("p25", "p50", "p75"), values, strict=True)}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(known.get(f"{c}|{k}", F.col(f"`{c}|{k}`") if not k.startswith("p") else F.lit(None)).alias(k) for k in parts)) for c in columns)))
    return rows.agg(*aggs).select(each.alias("x")).select("x.*")


def correlations(rows: DataFrame, target: str, features: Sequence[str], least: float = 0.95) -> DataFrame:
    """(feature, correlation, leaky): Pearson correlation with the target after nulls became 0."""
    filled = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (target, *features)))
    one = filled.agg(*(F.corr(f, target).alias(f) for f in features))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features)))
    return one.select(each.alias("x")).select("x.*").withColumn("leaky", F.abs("correlation") >= least)


def rank_correlations(rows: DataFrame, target: str, features: Sequence[str], least: float = 0.95) -> DataFrame:
    """(feature, correlation, leaky): Spearman correlation with the target after nulls became 0; equal values share a mean rank."""
    filled = rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (target, *features)))
    for c in (target, *features):
        filled = with_mean_rank(filled, c, f"rank_{c}").drop(c)
    one = filled.agg(*(F.corr(f"rank_{f}", f"rank_{target}").alias(f) for f in features))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features)))
    return one.select(each.alias("x")).select("x.*").withColumn("leaky", F.abs("correlation") >= least)


def feature_tests(rows: DataFrame, label: Column, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """(feature, test, statistic, df, p, importance): Welch's t or chi-squared of each feature, importance being -log10 p, at most 10."""
    parts = []
    if numeric:
        parts.append(welch(rows, label, numeric).select("feature", F.lit("welch").alias("test"), F.col("t").alias("statistic"), "df", tail(student_tail, F.col("t"), F.col("df")).alias("p")))
    for c in categorical:
        one = contingency(rows.withColumn("label", label.cast("int")), c, "label")
        df = rows.agg((F.countDistinct(c) - 1).cast("double").alias("df"))
        parts.append(one.join(F.broadcast(df)).select(F.lit(c).alias("feature"), F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "df", tail(chi2_tail, F.col("chi2"), F.col("df")).alias("p")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("importance", -F.log10(F.greatest("p", F.lit(1e-10))))


def signed_ranks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, z, p) of the signed-rank test of two metrics of the same groups, by the normal limit with ties.

    Differences of zero, and rows that lack either metric, don't count.
    """
    d = rows.select((F.col(a) - F.col(b)).alias("d")).filter("d != 0").withColumn("size", F.abs("d"))
    ranked = with_mean_rank(d, "size", "rank")
    ties = d.groupBy("size").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    one = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0)).alias("w_minus"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    out = one.join(F.broadcast(ties)).withColumn("z", F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(var)))
    return out.select("n", "w_plus", "w_minus", "z", tail(normal_tail, F.col("z")).alias("p"))


def fold_summary(rows: DataFrame, columns: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """(metric, n, mean, std, ci_low, ci_high): population deviation over the folds, and Student's interval of the mean."""
    one = rows.agg(*(x for c in columns for x in (F.count(c).alias(f"{c}|n"), F.avg(c).alias(f"{c}|mean"), F.stddev_pop(c).alias(f"{c}|std"))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), *(F.col(f"`{c}|{k}`").alias(k) for k in ("n", "mean", "std"))) for c in columns)))
    out = one.select(each.alias("x")).select("x.*")
    critical = tail(lambda n, c: student_quantile((1 + c) / 2, n - 1) if n > 1 else math.nan, F.col("n"), F.lit(confidence))
    half = critical * F.col("std") / F.sqrt("n")
    return out.select("*", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def error_rates(rows: DataFrame, label: Column, predicted: Column, classes: Sequence[object], eps: float = 1e-10) -> DataFrame:
    """(class, fp_rate, fn_rate): of each class, false calls over the rows of others, and missed ones over its own."""
    aggs = []
    for k, c in enumerate(classes):
        is_, called = label == F.lit(c), predicted == F.lit(c)
        aggs += [F.count_if(~is_ & called).alias(f"fp{k}"), F.count_if(~is_).alias(f"neg{k}"), F.count_if(is_ & ~called).alias(f"fn{k}"), F.count_if(is_).alias(f"pos{k}")]
    one = rows.agg(*aggs)
    each = F.array(*(F.struct(F.lit(c).alias("class"), (F.col(f"fp{k}") / (F.col(f"neg{k}") + eps)).alias("fp_rate"), (F.col(f"fn{k}") / (F.col(f"pos{k}") + eps)).alias("fn_rate")) for k, c in enumerate(classes)))
    return one.select(F.explode(each).alias("x")).select("x.*")


#: Ways to choose groups: by errors of both types or one, by those that hard_groups finds, at random, or all of them.
POLICIES = ("error_total", "error_fp", "error_fn", "hard", "random", "all")


def choose_groups(rows: DataFrame, by: Sequence[str], policy: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """The rows of n groups chosen by a policy; those with most errors first, ties in order of their names."""
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    if policy == "all":
        return rows
    if policy == "hard":
        chosen = hard_groups(confusion(rows, by), by, n=n)
    elif policy == "random":
        chosen = rows.select(*by).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by))), *by).limit(n)
    else:
        types = {"error_total": ("FP", "FN"), "error_fp": ("FP",), "error_fn": ("FN",)}[policy]
        chosen = effective_errors(rows, by, types=types).orderBy(F.col("total").desc(), *by).limit(n)
    return rows.join(chosen.select(*by), list(by), "left_semi")


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, t, p) of two metrics of the same groups; rows that lack either don't count."""
    d = F.col(a) - F.col(b)
    one = rows.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("s"))
    out = one.select("n", "mean_difference", F.try_divide(F.col("mean_difference") * F.sqrt("n"), F.col("s")).alias("t"))
    return out.withColumn("p", tail(student_tail, F.col("t"), F.col("n") - 1))


def tune(rows: DataFrame, masks: dict[str, Column], target: float) -> DataFrame:
    """(mask, rate) of the mask whose share of rows is closest to the target; of equal ones the first. All are counted in one pass."""
    names = list(masks)
    one = rows.agg(*(F.avg(masks[n].cast("double")).alias(f"m{k}") for k, n in enumerate(names)))
    each = F.array(*(F.struct(F.abs(F.col(f"m{k}") - target).alias("gap"), F.lit(k).alias("k"), F.lit(n).alias("mask"), F.col(f"m{k}").alias("rate")) for k, n in enumerate(names)))
    return one.select(F.array_min(each).alias("x")).select("x.mask", "x.rate")


def tune_uncertainty(rows: DataFrame, donor: Column, acceptor: Column, neither: Column, target: float = 0.1, entropies: Sequence[float] = (0.4, 0.5, 0.6, 0.7, 0.8), spreads: Sequence[float] = (0.1, 0.15, 0.2, 0.25, 0.3), highs: Sequence[float] = (0.7, 0.75, 0.8, 0.85, 0.9), **limits: object) -> DataFrame:
    """(entropy, spread, high, rate): the limits whose share of uncertain rows is closest to the target, the first of equal ones in this order."""
    grid = [(e, s, h) for e in entropies for s in spreads for h in highs]
    masks = {f"{e}|{s}|{h}": scores.uncertainty(donor, acceptor, neither, high=h, most_entropy=e, least_spread=s, **limits)["is_uncertain"] for e, s, h in grid}
    parts = F.split("mask", "[|]")
    return tune(rows, masks, target).select(*(parts[k].cast("double").alias(name) for k, name in enumerate(("entropy", "spread", "high"))), "rate")


def average_blocks(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means of predictions that overlapping blocks made for the same place."""
    return rows.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))
