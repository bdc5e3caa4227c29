"""Queries of metrics, tests, evaluation, patterns and event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, metrics, patterns, registry, sampling, sites, tables, validate, windows
from ..session import scratch_dir
from ..streaming import events as streams
from ..streaming import peaks
from .registry import longs, query, r6, rounded
from .views import Views

_COUNTS = "cast(count(*) filter (where pred_type = 'TP') as bigint) as TP, cast(count(*) filter (where pred_type = 'FP') as bigint) as FP, cast(count(*) filter (where pred_type = 'FN') as bigint) as FN, cast(count(*) filter (where pred_type = 'TN') as bigint) as TN"
_RATES = """round(coalesce(TP / nullif(TP + FP, 0), 0), 6) as precision, round(coalesce(TP / nullif(TP + FN, 0), 0), 6) as recall, round(coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0), 6) as f1_score,
  round(coalesce((TP + TN) / nullif(TP + FP + FN + TN, 0), 0), 6) as accuracy, round(coalesce(TN / nullif(TN + FP, 0), 0), 6) as specificity"""
_NAMES = ("precision", "recall", "f1_score", "accuracy", "specificity")


def _is_site() -> Column:
    return F.col("splice_type").isNotNull()


@query(f"select *, {_RATES} from (select gene_id, {_COUNTS} from positions group by gene_id)")
def confusion_metrics(v: Views) -> DataFrame:
    return rounded(metrics.confusion(v.positions, ["gene_id"]), *_NAMES)


@query(f"select *, {_RATES} from (select coalesce(splice_type, 'neither') as splice_type, {_COUNTS} from positions group by 1)")
def metrics_by_type(v: Views) -> DataFrame:
    return rounded(metrics.confusion(v.positions.withColumn("splice_type", F.coalesce("splice_type", F.lit("neither"))), ["splice_type"]), *_NAMES)


@query(f"select *, {_RATES} from (select strand, {_COUNTS} from positions group by strand)")
def micro_average(v: Views) -> DataFrame:
    return rounded(metrics.micro(metrics.confusion(v.positions, ["gene_id", "strand"]), ["strand"]), *_NAMES)


_CURVE = """steps as (select round(score, 6) as score, cast(count(*) filter (where splice_type is not null) as bigint) as pos, cast(count(*) filter (where splice_type is null) as bigint) as neg from positions group by 1),
cur as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, pos, neg from steps)"""


@query("select score, cast(tp as bigint) as tp, cast(fp as bigint) as fp from cur", _CURVE)
def pr_curve(v: Views) -> DataFrame:
    return metrics.curve(v.positions, _is_site(), "score").select("score", "tp", "fp")


@query("""select round(sum(neg * (tp + tp - pos) / 2.0) / (max(tp) * max(fp)), 6) as roc_auc, round(sum(pos * (tp / (tp + fp))) / max(tp), 6) as average_precision from cur""", _CURVE)
def roc_auc(v: Views) -> DataFrame:
    return rounded(metrics.areas(v.positions, _is_site(), "score").select("roc_auc", "average_precision"), "roc_auc", "average_precision")


@query("select round(sum(n * abs(acc - conf)) / (select count(*) from positions), 6) as ece from (select ceil(score * 10) as b, count(*) as n, avg(case when splice_type is not null then 1.0 else 0 end) as acc, avg(score) as conf from positions where score > 0 group by 1)")
def ece(v: Views) -> DataFrame:
    return rounded(metrics.calibration_error(v.positions, _is_site(), "score"), "ece")


@query("select k / 20.0::double as threshold, cast(count(*) filter (where score >= k / 20.0 and splice_type is not null) as bigint) as TP, cast(count(*) filter (where score >= k / 20.0 and splice_type is null) as bigint) as FP, cast(count(*) filter (where score < k / 20.0 and splice_type is not null) as bigint) as FN from positions, range(0, 21) r(k) group by k")
def threshold_sweep(v: Views) -> DataFrame:
    return metrics.threshold_sweep(v.positions, _is_site(), "score", [k / 20 for k in range(21)]).select("threshold", "TP", "FP", "FN")


@query("select threshold, round(f1, 6) as f1_score from (select k / 20.0::double as threshold, 2.0 * count(*) filter (where score >= k / 20.0 and splice_type is not null) / (count(*) filter (where score >= k / 20.0 and splice_type is not null) + count(*) filter (where score >= k / 20.0) - count(*) filter (where score >= k / 20.0 and splice_type is not null) + count(*) filter (where splice_type is not null)) as f1 from positions, range(0, 21) r(k) group by k) order by f1 desc, threshold limit 1")
def best_threshold(v: Views) -> DataFrame:
    return rounded(metrics.best_threshold(metrics.threshold_sweep(v.positions, _is_site(), "score", [k / 20 for k in range(21)])), "f1_score")


@query("""select feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) as cohens_d, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t from (
  select 'donor_score' as feature, avg(donor_score) filter (where s) as m1, avg(donor_score) filter (where not s) as m0, var_samp(donor_score) filter (where s) as v1, var_samp(donor_score) filter (where not s) as v0, count(*) filter (where s) as n1, count(*) filter (where not s) as n0 from (select *, splice_type is not null as s from positions)
  union all select 'score', avg(score) filter (where s), avg(score) filter (where not s), var_samp(score) filter (where s), var_samp(score) filter (where not s), count(*) filter (where s), count(*) filter (where not s) from (select *, splice_type is not null as s from positions))""")
def cohens_d(v: Views) -> DataFrame:
    return rounded(metrics.welch(v.positions, _is_site(), ["donor_score", "score"]), "cohens_d", "t").select("feature", "cohens_d", "t")


_CELLS = """cells as (select *, sum(o) over (partition by strand) * sum(o) over (partition by pred_type) / sum(o) over () as e, sum(o) over () as n from (select strand, pred_type, count(*)::double as o from positions group by all))"""


@query("select cast(max(n) as bigint) as n, round(sum((o - e) * (o - e) / e), 6) as chi2, round(sqrt(sum((o - e) * (o - e) / e) / max(n)), 6) as cramers_v, round(sum(o / n * ln(o / e)), 6) as mutual_information from cells", _CELLS)
def contingency(v: Views) -> DataFrame:
    return rounded(longs(metrics.contingency(v.positions, "strand", "pred_type"), "n"), "chi2", "cramers_v", "mutual_information")


@query("""select gene_id, round(p, 9) as p, round(least(min(p * n / r) over (order by r rows between current row and unbounded following), 1), 9) as q from (select gene_id, p, row_number() over (order by p, gene_id) as r, count(*) over () as n from (select gene_id, round(avg(donor_score), 12) as p from positions group by 1))""")
def bh_fdr(v: Views) -> DataFrame:
    p = v.positions.groupBy("gene_id").agg(F.round(F.avg("donor_score"), 12).alias("p"))
    # Nine places: means of a few dozen scores often end in a 5 at the seventh.
    out = metrics.benjamini_hochberg(p, "p")
    return out.select("gene_id", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("select feature, round(c, 6) as correlation, abs(c) >= 0.95 as leaky from (select 'donor_score' as feature, corr(donor_score, neither_score) as c from positions union all select 'acceptor_score', corr(acceptor_score, neither_score) from positions)")
def leakage_correlation(v: Views) -> DataFrame:
    return rounded(metrics.correlations(v.positions, "neither_score", ["donor_score", "acceptor_score"]), "correlation")


@query("select strand, round(avg(f1), 6) as mean_f1, round(stddev_pop(f1), 6) as std_f1, cast(count(*) as bigint) as n from (select strand, gene_id, coalesce(2.0 * count(*) filter (where pred_type = 'TP') / nullif(2 * count(*) filter (where pred_type = 'TP') + count(*) filter (where pred_type in ('FP', 'FN')), 0), 0) as f1 from positions group by 1, 2) group by strand")
def fold_metrics(v: Views) -> DataFrame:
    per = metrics.confusion(v.positions, ["strand", "gene_id"])
    return per.groupBy("strand").agg(F.avg("f1_score").alias("m"), F.stddev_pop("f1_score").alias("s"), F.count("*").alias("n")).select("strand", *r6(mean_f1=F.col("m"), std_f1=F.col("s")), "n")


@query(f"select gene_id, FP, n, round(FP / n, 6) as fp_share from (select gene_id, cast(count(*) filter (where pred_type = 'FP') as bigint) as FP, cast(count(*) as bigint) as n from positions where splice_type is null group by 1) order by FP desc, gene_id limit 10")
def fp_share_genes(v: Views) -> DataFrame:
    rows = v.positions.filter("splice_type is null").groupBy("gene_id").agg(F.count_if(F.col("pred_type") == "FP").alias("FP"), F.count("*").alias("n"))
    return rounded(rows.withColumn("fp_share", F.col("FP") / F.col("n")), "fp_share").orderBy(F.col("FP").desc(), "gene_id").limit(10)


@query("""select gene_id, round(base, 9) as base_score, round(meta, 9) as meta_score, round(meta - base, 9) as delta from (select gene_id, avg(greatest(donor_score, acceptor_score)) as base, avg(score) as meta from positions group by 1)""")
def gene_score_delta(v: Views) -> DataFrame:
    rows = v.positions.groupBy("gene_id").agg(F.avg(F.greatest("donor_score", "acceptor_score")).alias("b"), F.avg("score").alias("m"))
    return rows.select("gene_id", F.round("b", 9).alias("base_score"), F.round("m", 9).alias("meta_score"), F.round(F.col("m") - F.col("b"), 9).alias("delta"))


def _evaluation(tag: str, kind: str, score: str, threshold: float, mode: str) -> str:
    """Common tables: `tag` has the evaluation of one site type, matched by recursion over each gene's positives."""
    gap = f"(select min(abs(n.position - c.position)) from {tag}_called c where c.gene_id = n.gene_id and c.pred_type <> 'FN')"
    md5 = "md5('42|' || gene_id || '|' || position)"
    order = {"random": f"{md5}, position", "proximity": f"gap, case when gap is null then {md5} end, position", "window": f"coalesce(gap > 50, false), {md5}, position"}[mode]
    some = "where size <= quota or not coalesce(gap > 50, false)" if mode == "window" else ""
    return f"""{tag}_true as (select gene_id, position as t, row_number() over (partition by gene_id order by position) as j from (select distinct gene_id, position from pos1 where splice_type = '{kind}')),
{tag}_pos as (select gene_id, position, row_number() over (partition by gene_id order by position) as i, (select count(*) from {tag}_true t where t.gene_id = p.gene_id and t.t < p.position - 2) as lo, (select count(*) from {tag}_true t where t.gene_id = p.gene_id and t.t <= p.position + 2) as hi
  from pos1 p where {score} >= {threshold} and gene_id in (select gene_id from {tag}_true)),
{tag}_step as (select distinct gene_id, cast(0 as bigint) as i, cast(null as bigint) as position, cast(0 as bigint) as taken, false as hit from {tag}_true
  union all select p.gene_id, p.i, p.position, greatest(s.taken, p.lo) + case when greatest(s.taken, p.lo) < p.hi then 1 else 0 end, greatest(s.taken, p.lo) < p.hi from {tag}_step s join {tag}_pos p on p.gene_id = s.gene_id and p.i = s.i + 1),
{tag}_hits as (select s.gene_id, s.position, case when hit then 'TP' else 'FP' end as pred_type, t.t as true_position from {tag}_step s left join {tag}_true t on hit and t.gene_id = s.gene_id and t.j = s.taken where s.i > 0),
{tag}_called as (select * from {tag}_hits union all select gene_id, t, 'FN', t from {tag}_true t where not exists (select 1 from {tag}_hits h where h.gene_id = t.gene_id and h.true_position = t.t)),
{tag}_negative as (select gene_id, position, {gap} as gap, quota, count(*) over (partition by gene_id) as size from pos1 n join (select gene_id, floor(count(*) * 1.2) as quota from {tag}_called group by 1) using (gene_id)
  where {score} < {threshold} and not exists (select 1 from {tag}_called c where c.gene_id = n.gene_id and abs(c.true_position - n.position) <= 2 and (c.pred_type = 'FN' or c.position > n.position))),
{tag} as (select * from {tag}_called union all select gene_id, position, 'TN', null from (select *, row_number() over (partition by gene_id order by {order}) as r from {tag}_negative {some}) where r <= quota)"""


def _evaluated(v: Views, mode: str) -> DataFrame:
    kinds = {"donor": "donor_score", "acceptor": "acceptor_score"}
    true = v.pos1.filter("splice_type is not null").select("gene_id", "position", F.col("splice_type").alias("site_type"))
    return evaluate.evaluate_sites(v.pos1, true, "gene_id", "long", kinds, threshold=0.4, tn_factor=1.2, tn_mode=mode)


_ALL_TYPES = "select *, 'donor' as site_type from {0}_donor union all select *, 'acceptor' from {0}_acceptor"


def _both(mode: str) -> dict[str, object]:
    return {"recursive": True, "sql": _ALL_TYPES.format(mode), "more": ",\n".join(_evaluation(f"{mode}_{kind}", kind, f"{kind}_score", 0.4, mode) for kind in ("donor", "acceptor"))}


@query(**_both("random"))
def evaluate_predictions(v: Views) -> DataFrame:
    return _evaluated(v, evaluate.RANDOM)


@query(**_both("proximity"))
def evaluate_near_negatives(v: Views) -> DataFrame:
    return _evaluated(v, evaluate.PROXIMITY)


@query(**_both("window"))
def evaluate_window_negatives(v: Views) -> DataFrame:
    return _evaluated(v, evaluate.WINDOW)


_SHIFTS = """sh as (select k, 2.0 * count(*) filter (where h and s) / nullif(2 * count(*) filter (where h and s) + count(*) filter (where h <> s), 0) as f1 from (
  select k, coalesce(splice_type = 'donor', false) as s, case when k > 0 then coalesce(lag(donor_score, k) over w, 0) when k < 0 then coalesce(lead(donor_score, -k) over w, 0) else donor_score end >= 0.4 as h
  from (select p.*, k from pos1 p, (values (0), (-2), (-1), (1), (2)) v(k)) window w as (partition by k, gene_id order by position)) group by k)"""


@query("select cast(case when f1 > z then k else 0 end as bigint) as shift, round(case when f1 > z then f1 else z end, 6) as f1 from (select *, (select f1 from sh where k = 0) as z from sh order by f1 desc limit 1)", _SHIFTS)
def shift_search(v: Views) -> DataFrame:
    label = F.coalesce(F.col("splice_type") == "donor", F.lit(False))
    return rounded(evaluate.best_shift(v.pos1, ["gene_id"], "donor_score", label, 0.4, [0, -2, -1, 1, 2]), "f1")


@query("select * from missed_called where pred_type = 'FN'", _evaluation("missed", "donor", "score", 0.5, "random"), recursive=True)
def evaluate_missed_sites(v: Views) -> DataFrame:
    true = v.pos1.filter("splice_type = 'donor'").select("gene_id", "position")
    return evaluate.evaluate(v.pos1.select("gene_id", "position", "score"), true, "gene_id", "long", "score").filter("pred_type = 'FN'")


_GRID = """sg as (select strand, t, k, o, coalesce(2.0 * count(*) filter (where h and s) / nullif(2 * count(*) filter (where h and s) + count(*) filter (where h <> s), 0), 0) as f1 from (
  select strand, t, k, o, coalesce(splice_type = t, false) as s, case when k > 0 then coalesce(lag(x, k) over w, 0) when k < 0 then coalesce(lead(x, -k) over w, 0) else x end >= 0.4 as h
  from (select p.*, k, o, t, case t when 'donor' then donor_score else acceptor_score end as x from pos1 p, (values (0, 0), (-2, 1), (-1, 2), (1, 3), (2, 4)) v(k, o), (values ('donor'), ('acceptor')) u(t)) window w as (partition by k, t, strand, gene_id order by position)) group by strand, t, k, o)"""


@query("select strand, t as site_type, cast(case when f1 > z then k else 0 end as bigint) as shift, round(case when f1 > z then f1 else z end, 6) as f1 from (select *, (select f1 from sg z where z.k = 0 and z.strand = sg.strand and z.t = sg.t) as z from sg qualify row_number() over (partition by strand, t order by f1 desc, o) = 1)", _GRID)
def shift_grid(v: Views) -> DataFrame:
    return rounded(evaluate.shift_grid(v.pos1, ["gene_id"], {"donor": "donor_score", "acceptor": "acceptor_score"}, "splice_type", 0.4, [0, -2, -1, 1, 2]), "f1")


@query("""select * from (values ('absent', 'missing'), ('strand', 'string instead of bigint'), ('donor_score', 'double instead of float'), ('acceptor_score', 'double instead of float'), ('neither_score', 'double instead of float'), ('[0-9]mer_.*', '0 columns')) t("column", problem)""")
def schema_report(v: Views) -> DataFrame:
    return validate.schema_violations(v.positions, {"gene_id": "int|bigint", "strand": "bigint", "absent": "string"}, {".*_score": "float", "[0-9]mer_.*": "bigint"}, {"[0-9]mer_.*": 64})


@query("""select order_id, line_id, position, greatest(0, position - 50) as window_start, least(2000, position + 50) as window_end from positions where pred_type in ('FP', 'FN')""")
def error_windows(v: Views) -> DataFrame:
    return evaluate.error_windows(v.positions, F.lit(2000), 50, 50).select("order_id", "line_id", "position", "window_start", "window_end")


@query("""select order_id, line_id, POS, site_type, event, round(s, 6) as delta_score, p as position, case when s >= 0.8 then 'high' when s >= 0.5 then 'moderate' else 'low' end as category from (
  select order_id, line_id, gene_id as POS, unnest(['acceptor', 'acceptor', 'donor', 'donor']) as site_type, unnest(['gain', 'loss', 'gain', 'loss']) as event, unnest([donor_score, acceptor_score, neither_score, score]) as s, unnest([gene_id + 1, gene_id - 2, gene_id + 3, gene_id - 4]) as p from positions) where s >= 0.2""")
def delta_to_sites(v: Views) -> DataFrame:
    rows = v.positions.select(
        F.concat_ws("|", "order_id", "line_id", "transcript_id", "position").alias("CHROM"), F.col("gene_id").alias("POS"), F.col("donor_score").alias("DS_AG"), F.col("acceptor_score").alias("DS_AL"), F.col("neither_score").alias("DS_DG"), F.col("score").alias("DS_DL"),
        F.lit(1).alias("DP_AG"), F.lit(-2).alias("DP_AL"), F.lit(3).alias("DP_DG"), F.lit(-4).alias("DP_DL"),
    )
    out = sites.delta_sites(rows)
    key = F.split("CHROM", r"\|")
    return rounded(out.select(key[0].cast("long").alias("order_id"), key[1].cast("long").alias("line_id"), "POS", "site_type", "event", "delta_score", "position", "category"), "delta_score")


#: Sites with changes: canonical or cryptic ones that are raised or lowered, or stay as they are; the factor keeps rounded figures off halves.
_CHANGED = """changed as (
  select gene_id, (position + case when site_type = 'donor' then 0 else position % 3 end) as position, site_type, case when is_suppressed then -score when score > 0.05 then score else 0.0 end * 0.7310585 as delta_score, is_canonical, not is_canonical as is_cryptic from sites
), nx as (
  select *, lead(site_type) over w as nt, lead(position) over w as np, lead(delta_score) over w as nd, lead(is_canonical) over w as nc from changed window w as (partition by gene_id order by position, site_type)
), pair_down as (
  select * from nx where is_canonical and nc and delta_score < 0 and nd < 0
)"""


def _changed(v: Views) -> DataFrame:
    at = F.col("position") + F.when(F.col("site_type") == "donor", 0).otherwise(F.col("position") % 3)
    delta = F.when(F.col("is_suppressed"), -F.col("score")).when(F.col("score") > 0.05, F.col("score")).otherwise(0.0) * 0.7310585
    return v.sites.select("gene_id", at.alias("position"), "site_type", delta.alias("delta_score"), "is_canonical", (~F.col("is_canonical")).alias("is_cryptic"))


def _severity_sql(deltas: str) -> str:
    sizes = f"list_transform(list_filter([{deltas}], lambda x: x is not null), lambda x: abs(x))"
    return f"(list_max({sizes}) + list_avg({sizes})) / 2"


@query(f"""select gene_id, position as exon_start, np as exon_end, np - position as exon_size, up.position as upstream_donor, dn.position as downstream_acceptor, len(list_filter([up.position, dn.position], lambda x: x is not null)) + 2 as num_sites, round(severity, 6) as severity,
  round(least(1.0, least(1.0, severity) * case when abs(delta_score) > 0.5 and abs(nd) > 0.5 then 1.2 else 1 end), 6) as confidence from (
  select *, {_severity_sql('delta_score, nd, up.delta_score, dn.delta_score')} as severity from (
    select p.*, (select case when c.delta_score > 0 then {{'position': c.position, 'delta_score': c.delta_score}} end from changed c where c.gene_id = p.gene_id and c.site_type = 'donor' and c.position < p.position order by c.position desc limit 1) as up,
      (select case when c.delta_score > 0 then {{'position': c.position, 'delta_score': c.delta_score}} end from changed c where c.gene_id = p.gene_id and c.site_type = 'acceptor' and c.position > p.np order by c.position limit 1) as dn
    from pair_down p where site_type = 'acceptor' and nt = 'donor' and np - position between 5 and 5000))""", _CHANGED)
def exon_skip_pattern(v: Views) -> DataFrame:
    return rounded(patterns.skipped_exons(_changed(v), ["gene_id"], least=5), "severity", "confidence")


@query(f"""select gene_id, position as intron_start, np as intron_end, np - position as intron_size, round(severity, 6) as severity, round(least(1.0, severity), 6) as confidence from (select *, {_severity_sql('delta_score, nd')} as severity from pair_down where site_type = 'donor' and nt = 'acceptor')""", _CHANGED)
def intron_retention(v: Views) -> DataFrame:
    return rounded(patterns.retained_introns(_changed(v), ["gene_id"]), "severity", "confidence")


@query(f"""select gene_id, case site_type when 'donor' then 'alternative_5ss' else 'alternative_3ss' end as pattern_type, canonical_position, alternative_position, alternative_position - canonical_position as shift, round(severity, 6) as severity, round(least(1.0, severity), 6) as confidence from (
  select a.gene_id, a.site_type, a.position as canonical_position, b.position as alternative_position, {_severity_sql('a.delta_score, b.delta_score')} as severity
  from changed a join changed b on a.gene_id = b.gene_id and a.site_type = b.site_type and a.is_canonical and a.delta_score < 0 and b.delta_score > 0 and abs(a.position - b.position) <= 30)""", _CHANGED)
def alt_site_pairs(v: Views) -> DataFrame:
    return rounded(patterns.alternative_sites(_changed(v), ["gene_id"], 30), "severity", "confidence")


@query(f"""select gene_id, case when delta_score > 0 then 'cryptic_activation' else 'cryptic_suppression' end as pattern_type, cryptic_position, site_type, near.position as canonical_position, case when near is null then 1 else 2 end::bigint as num_sites, round(severity, 6) as severity,
  round(least(1.0, least(1.0, severity) * case when delta_score > 0.8 then 1.15 else 1 end), 6) as confidence from (select *, {_severity_sql('delta_score, near.delta_score')} as severity from (
    select gene_id, site_type, position as cryptic_position, delta_score, (select {{'position': c.position, 'delta_score': c.delta_score}} from changed c where c.gene_id = p.gene_id and c.site_type = p.site_type and c.is_canonical order by abs(c.position - p.position), c.position limit 1) as near
    from changed p where is_cryptic and abs(delta_score) >= 0.2))""", _CHANGED)
def cryptic_nearest(v: Views) -> DataFrame:
    return rounded(patterns.cryptic_sites(_changed(v), ["gene_id"]), "severity", "confidence")


@query("""select pattern_type, cast(count(*) as bigint) as n from (
  select 'exon_skipping' as pattern_type from pair_down where site_type = 'acceptor' and nt = 'donor' and np - position between 50 and 5000
  union all select 'intron_retention' from pair_down where site_type = 'donor' and nt = 'acceptor'
  union all select case a.site_type when 'donor' then 'alternative_5ss' else 'alternative_3ss' end from changed a join changed b on a.gene_id = b.gene_id and a.site_type = b.site_type and a.is_canonical and a.delta_score < 0 and b.delta_score > 0 and abs(a.position - b.position) <= 300
  union all select case when delta_score > 0 then 'cryptic_activation' else 'cryptic_suppression' end from changed where is_cryptic and abs(delta_score) >= 0.2) group by 1""", _CHANGED)
def ranked_patterns(v: Views) -> DataFrame:
    """All patterns but the complex ones, which SQL can't put together, by kind."""
    return patterns.ranked_patterns(_changed(v), ["gene_id"]).filter("pattern_type <> 'complex_pattern'").groupBy("pattern_type").agg(F.count("*").alias("n"))


@query("""select gene_id, cluster, cast(count(*) as bigint) as n, min(position) as first_position, max(position) as last_position from (select *, cast(sum(fresh) over (partition by gene_id order by position) as bigint) as cluster from (
  select *, case when position - lag(position) over (partition by gene_id order by position) <= 14 then 0 else 1 end as fresh from sites where is_activated)) group by gene_id, cluster""")
def site_components(v: Views) -> DataFrame:
    return sites.clusters(v.sites.filter("is_activated"), ["gene_id"], 14)


_RANKS = """rk as (select d - 0.0 as d, a, n, rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0 as rd, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as rn from (select round(donor_score, 6) as d, round(acceptor_score, 6) as a, round(neither_score, 6) as n from positions))"""


@query("select 'd' as feature, round(corr(rd, rn), 6) as correlation, abs(corr(rd, rn)) >= 0.95 as leaky from rk union all select 'a', round(corr(ra, rn), 6), abs(corr(ra, rn)) >= 0.95 from rk", _RANKS)
def leakage_rank_correlation(v: Views) -> DataFrame:
    rows = v.positions.select(F.round("donor_score", 6).alias("d"), F.round("acceptor_score", 6).alias("a"), F.round("neither_score", 6).alias("n"))
    return rounded(metrics.rank_correlations(rows, "n", ["d", "a"]), "correlation")


_SIGNED = """sg as (select gene_id, round(avg(donor_score) - avg(score), 6) as d from positions group by 1), sr as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from sg where d <> 0),
ss as (select cast(count(*) as bigint) as n, coalesce(sum(r) filter (where d > 0), 0) as w_plus, coalesce(sum(r) filter (where d < 0), 0) as w_minus, (select sum(t * t * t - t) from (select count(*)::double as t from sg where d <> 0 group by abs(d))) as ties from sr)"""


@query("select n, round(w_plus, 3) as w_plus, round(w_minus, 3) as w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48), 6) as z from ss", _SIGNED)
def signed_rank_test(v: Views) -> DataFrame:
    per = v.positions.groupBy("gene_id").agg(F.round(F.avg("donor_score") - F.avg("score"), 6).alias("d")).withColumn("zero", F.lit(0.0))
    out = metrics.signed_ranks(per, "d", "zero")
    return out.select("n", F.round(F.col("w_plus").cast("double"), 3).alias("w_plus"), F.round(F.col("w_minus").cast("double"), 3).alias("w_minus"), F.round("z", 6).alias("z"))


@query("""select class, round(cast(fp as double) / (neg + 1e-10), 6) as fp_rate, round(cast(fn as double) / (pos + 1e-10), 6) as fn_rate from (
  select c as class, count(*) filter (where l <> c and p = c) as fp, count(*) filter (where l <> c) as neg, count(*) filter (where l = c and p <> c) as fn, count(*) filter (where l = c) as pos
  from (select case splice_type when 'donor' then 1 when 'acceptor' then 2 else 0 end as l, case when donor_score >= 0.25 then 1 when acceptor_score >= 0.25 then 2 else 0 end as p from positions), (values (0), (1), (2)) k(c) group by c)""")
def class_error_rates(v: Views) -> DataFrame:
    label = F.when(F.col("splice_type") == "donor", 1).when(F.col("splice_type") == "acceptor", 2).otherwise(0)
    called = F.when(F.col("donor_score") >= 0.25, 1).when(F.col("acceptor_score") >= 0.25, 2).otherwise(0)
    return rounded(metrics.error_rates(v.positions, label, called, [0, 1, 2]), "fp_rate", "fn_rate")


@query("""select metric, n, round(mean, 6) as mean, round(std, 6) as std from (select 'precision' as metric, cast(count(*) as bigint) as n, avg(precision) as mean, stddev_pop(precision) as std from ev union all select 'recall', count(*), avg(recall), stddev_pop(recall) from ev)""",
  f"ev as (select strand, {_RATES} from (select strand, {_COUNTS} from positions group by strand))")
def fold_intervals(v: Views) -> DataFrame:
    per = rounded(metrics.confusion(v.positions, ["strand"]), "precision", "recall")
    return rounded(metrics.fold_summary(per, ["precision", "recall"]).select("metric", "n", "mean", "std"), "mean", "std")


_CHOSEN = "select order_id, line_id from positions where gene_id in (select gene_id from (select gene_id, count(distinct position) as e from positions where pred_type in ({types}) group by 1) order by e desc, gene_id limit 20)"


@query(_CHOSEN.format(types="'FP', 'FN'"))
def genes_by_errors(v: Views) -> DataFrame:
    return metrics.choose_groups(v.positions, ["gene_id"], "error_total", 20).select("order_id", "line_id")


@query(_CHOSEN.format(types="'FP'"))
def genes_by_false_positives(v: Views) -> DataFrame:
    return metrics.choose_groups(v.positions, ["gene_id"], "error_fp", 20).select("order_id", "line_id")


@query("select order_id, line_id from positions where gene_id in (select gene_id from (select distinct gene_id from positions) order by md5('42|' || gene_id), gene_id limit 20)")
def genes_at_random(v: Views) -> DataFrame:
    return metrics.choose_groups(v.positions, ["gene_id"], "random", 20).select("order_id", "line_id")


_PLACE = "('0x' || substr(md5('42|' || gene_id), 1, 8))::uint64 / 4294967296.0"


@query(f"""select fold, role, cast(count(*) as bigint) as n from (select f as fold, case when list_contains(string_split(f, ','), strand) then 'test' when {_PLACE} < least(0.15 / greatest(0.01, 1 - (select count(*) filter (where list_contains(string_split(f, ','), p.strand)) / count(*) from positions p)), 0.4) then 'valid' else 'train' end as role
  from positions, (values ('+'), ('-')) k(f)) group by 1, 2""")
def leave_out_folds(v: Views) -> DataFrame:
    return sampling.leave_out_folds(v.positions.select("gene_id", "strand"), "strand", "gene_id", [["+"], ["-"]]).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("select order_id, line_id, case when pred_type = 'FP' then 1 else 0 end as label from positions")
def positive_class(v: Views) -> DataFrame:
    return tables.positive_label(v.positions.select("order_id", "line_id", "pred_type"))


@query("""select id, cast((length(sequence) - length(replace(sequence, 'AC', ''))) // 2 as bigint) as "2mer_AC", cast((length(sequence) - length(replace(sequence, 'GT', ''))) // 2 as bigint) as "2mer_GT",
  round(case when length(sequence) > 0 then (length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence) else 0 end, 6) as gc_content from seqs""")
def kmer_features(v: Views) -> DataFrame:
    return rounded(tables.kmer_features(v.seqs, "id", "sequence", [2], least=5).select("id", "2mer_AC", "2mer_GT", "gc_content"), "gc_content")


@query("""select gene_id, min(position) as first_position, max(position) as last_position, cast(count(*) as bigint) as num_sites, cast(count(*) filter (where delta_score > 0) as bigint) as activated, cast(count(*) filter (where delta_score < 0) as bigint) as suppressed,
  case when count(*) filter (where site_type = 'donor') > 2 and count(*) filter (where site_type = 'acceptor') > 2 then 'multiple_exon_changes' when bool_or(not is_canonical) and bool_or(is_canonical) then 'mixed_canonical_cryptic' else 'unclassified_complex' end as subtype from members group by gene_id, root having count(distinct position) >= 3 and activated >= 2 and suppressed >= 2""", _CHANGED + """, coarse as (
  select * replace ((position // 28) * 28 as position) from changed
), runs as (
  select gene_id, position, sign(delta_score) as sign, cast(sum(fresh) over (partition by gene_id, sign(delta_score) order by position) as bigint) as run from (select *, case when position - lag(position) over (partition by gene_id, sign(delta_score) order by position) <= 56 then 0 else 1 end as fresh from coarse where delta_score <> 0)
), ends as (
  select distinct gene_id, sign, run, position from runs
), linked as (
  select a.gene_id, a.sign * 1000000 + a.run as a, b.sign * 1000000 + b.run as b from ends a join ends b on a.gene_id = b.gene_id and a.position = b.position group by all
), reach(gene_id, a, b) as (
  select gene_id, a, b from linked union select r.gene_id, r.a, l.b from reach r join linked l on r.gene_id = l.gene_id and r.b = l.a
), roots as (
  select gene_id, a, min(b) as root from reach group by 1, 2
), places as (
  select distinct e.gene_id, e.position, r.root from ends e join roots r on e.gene_id = r.gene_id and e.sign * 1000000 + e.run = r.a
), members as (
  select c.*, p.root from coarse c join places p on c.gene_id = p.gene_id and c.position = p.position
)""", recursive=True)
def complex_patterns(v: Views) -> DataFrame:
    """Groups of places, each 28 bases wide, so that donors and acceptors meet in them."""
    coarse = _changed(v).withColumn("position", F.expr("position div 28 * 28"))
    return patterns.complex_groups(coarse, ["gene_id"], 56).drop("severity", "confidence")


@query("""select cast(width_start as timestamp) as start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from (select time_bucket(interval '1 day', ts) as width_start, event_type, value from events) group by all""")
def tumbling_window(v: Views) -> DataFrame:
    rows = streams.tumbling(v.table("events"))
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""select user_id, cast(min(ts) as timestamp) as start, cast(count(*) as bigint) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '2 hours' then 0 else 1 end as fresh from events)) group by user_id, s""")
def session_window(v: Views) -> DataFrame:
    return streams.sessions(v.table("events")).select("user_id", "start", "n")


_PEAKS = """apart as (
  select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '2 hours' then 0 else 1 end as fresh from events)
)"""
_PEAK_SQL = """select user_id, cast(min(ts) as timestamp) as start, cast(max(ts) as timestamp) as "end", cast(count(*) as bigint) as n, max(value) as peak, cast(arg_max(ts, {'v': value, 'late': -epoch_us(ts)}) as timestamp) as peak_at from apart group by user_id, s"""


@query(_PEAK_SQL, _PEAKS)
def session_peaks(v: Views) -> DataFrame:
    return peaks.session_peaks(v.table("events"))


@query(_PEAK_SQL, _PEAKS)
def session_peaks_streamed(v: Views) -> DataFrame:
    """The same by a stream over files of the table and a row far ahead, which closes the last sessions."""
    folder = scratch_dir(v.spark, "stream")
    rows = v.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    ahead = rows.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(0.0).alias("value"))
    rows.unionByName(ahead).write.parquet(f"{folder}/in")
    stream = peaks.session_peaks(streams.read_events(v.spark, f"{folder}/in", files_a_trigger=1_000_000))
    streams.to_table(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return v.spark.read.schema(peaks.OUT).parquet(f"{folder}/out")


@query("select user_id, cast(count(value) as bigint) as n, round(avg(value), 4) as mean, round(var_pop(value), 2) as variance, round(min(value), 4) as least, round(max(value), 4) as most from events group by user_id")
def running_stats(v: Views) -> DataFrame:
    rows = streams.running_stats(v.table("events"))
    return rows.select("user_id", "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("least", 4).alias("least"), F.round("most", 4).alias("most"))


@registry.enricher("score_sum")
def _score_sum(rows: DataFrame, **_: object) -> DataFrame:
    return rows.withColumn("score_sum", F.col("donor_score") + F.col("acceptor_score"))


@registry.enricher("gene_errors")
def _gene_errors(rows: DataFrame, **_: object) -> DataFrame:
    errors = rows.filter("pred_type in ('FP', 'FN')").groupBy("gene_id").agg(F.count("*").alias("n_errors"))
    return rows.join(errors, "gene_id", "left").fillna(0, ["n_errors"])


@query("select order_id, line_id, round(donor_score + acceptor_score, 6) as score_sum, coalesce(n_errors, 0) as n_errors from positions left join (select gene_id, cast(count(*) as bigint) as n_errors from positions where pred_type in ('FP', 'FN') group by 1) using (gene_id)")
def enrichers(v: Views) -> DataFrame:
    return rounded(registry.enrich(v.positions, ["score_sum", "gene_errors"]).select("order_id", "line_id", "score_sum", "n_errors"), "score_sum")


@query("select gene_id, position, round(donor_score * 0.9 + 0.05, 6) as meta_score from pos1")
def batch_model(v: Views) -> DataFrame:
    def model(batch):
        return batch[["gene_id", "position"]].assign(meta_score=(batch["donor_score"] * 0.9 + 0.05).round(6))

    return sites.score_batches(v.pos1, model, ["gene_id", "position", "donor_score"], "gene_id long, position long, meta_score double")


def flagship(v: Views) -> DataFrame:
    """Derived features, the best prediction type of each place, and the ten genes that fare worst."""
    best = windows.by_priority(v.derived(), ["gene_id", "position", "strand"])
    scored = metrics.confusion(best, ["gene_id"])
    entropy = best.groupBy("gene_id").agg(F.avg("probability_entropy").alias("mean_entropy"))
    worst = scored.join(entropy, "gene_id").orderBy(F.col("f1_score"), F.col("FP").desc(), "gene_id").limit(10)
    return rounded(worst.select("gene_id", "TP", "FP", "FN", "TN", "precision", "recall", "f1_score", "mean_entropy"), "precision", "recall", "f1_score", "mean_entropy")


@query("""select gene_id, TP, FP, FN, TN, round(coalesce(TP / nullif(TP + FP, 0), 0), 6) as precision, round(coalesce(TP / nullif(TP + FN, 0), 0), 6) as recall, round(f1, 6) as f1_score, round(e, 6) as mean_entropy from (
  select *, coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0) as f1 from (select gene_id, """ + _COUNTS + """, avg(-(donor_score * ln(donor_score + 1e-10) + acceptor_score * ln(acceptor_score + 1e-10) + coalesce(neither_score * case when neither_score + 1e-10 > 0 then ln(neither_score + 1e-10) end, 0))) as e
  from (select * from positions qualify dense_rank() over (partition by gene_id, position, strand order by case pred_type when 'TP' then 0 when 'FN' then 1 when 'FP' then 2 else 3 end) = 1) group by gene_id)) order by f1, FP desc, gene_id limit 10""")
def worst_genes(v: Views) -> DataFrame:
    return flagship(v)
