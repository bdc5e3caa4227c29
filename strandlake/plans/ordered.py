"""Queries of windows, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, sampling, sites, tables, windows
from ..operators import peaks as peak_tracks
from .registry import longs, query, rounded
from .views import Views


@query("select order_id, line_id, gene_id, position, strand, pred_type from positions qualify dense_rank() over (partition by gene_id, position, strand order by case pred_type when 'TP' then 0 when 'FN' then 1 when 'FP' then 2 else 3 end) = 1")
def priority_dedupe(v: Views) -> DataFrame:
    return windows.by_priority(v.positions.select("order_id", "line_id", "gene_id", "position", "strand", "pred_type"), ["gene_id", "position", "strand"])


@query("""select order_id, line_id, gene_id, position, strand, pred_type, n_transcripts, all_transcripts from (select *, dense_rank() over (partition by gene_id, position, strand order by case pred_type when 'TP' then 0 when 'FN' then 1 when 'FP' then 2 else 3 end) as r from positions)
  join (select gene_id, position, strand, cast(count(distinct transcript_id) as bigint) as n_transcripts, list_aggregate(list_sort(list_distinct(list(transcript_id))), 'string_agg', ',') as all_transcripts from positions group by all) using (gene_id, position, strand) where r = 1""")
def dedupe_with_sets(v: Views) -> DataFrame:
    rows = windows.resolve_conflicts(v.positions)
    return rows.select("order_id", "line_id", "gene_id", "position", "strand", "pred_type", "n_transcripts", F.array_join(F.transform("all_transcripts", lambda x: x.cast("string")), ",").alias("all_transcripts"))


@query("select gene_id, position, round(m2, 6) as m2, round(m1, 6) as m1, round(p1, 6) as p1, round(p2, 6) as p2 from context")
def context_window(v: Views) -> DataFrame:
    return v.context.select("gene_id", "position", *(F.round(f"context_score_{k}", 6).alias(k) for k in ("m2", "m1", "p1", "p2")))


@query("""select gene_id, position, case when count(*) over w = 5 then round(avg(donor_score) over w, 6) end as donor_score_rolling_mean, case when count(*) over w = 5 then round(stddev_samp(donor_score) over w, 6) end as donor_score_rolling_std
  from pos1 window w as (partition by gene_id order by position rows between 2 preceding and 2 following)""")
def rolling_stats(v: Views) -> DataFrame:
    rows = windows.rolling(v.pos1.select("gene_id", "position", "donor_score"), ["gene_id"], "donor_score")
    return rounded(rows.drop("donor_score"), "donor_score_rolling_mean", "donor_score_rolling_std")


@query("""select gene_id, position, round(coalesce(lead(donor_score, 2) over w, 0), 6) as donor_score_shifted, round(coalesce(lead(neither_score, 2) over w, 1), 6) as neither_score_shifted from pos1 window w as (partition by gene_id order by position)""")
def shift_scores(v: Views) -> DataFrame:
    rows = windows.read_from(v.pos1, ["gene_id"], {"donor_score": 0.0, "neither_score": 1.0}, 2)
    return rounded(rows.select("gene_id", "position", "donor_score_shifted", "neither_score_shifted"), "donor_score_shifted", "neither_score_shifted")


@query("""select gene_id, position, round(case strand when '+' then coalesce(lag(donor_score, 2) over w, 0) else coalesce(lag(donor_score, 1) over w, 0) end, 6) as donor_score_adjusted from pos1 window w as (partition by gene_id order by position)""")
def roll_adjustment(v: Views) -> DataFrame:
    rows = windows.move_by_strand(v.pos1, ["gene_id"], "donor_score", {"+": 2, "-": 1})
    return rounded(rows.select("gene_id", "position", "donor_score_adjusted"), "donor_score_adjusted")


@query("""select gene_id, session, min(position) as first_position, max(position) as last_position, cast(count(*) as bigint) as n, arg_min(position, [-score, position]) as peak_position, round(max(score), 6) as peak_score from (
  select *, cast(sum(fresh) over (partition by gene_id order by position) as bigint) as session from (select gene_id, position, score, case when position - lag(position) over (partition by gene_id order by position) <= 20 then 0 else 1 end as fresh from pos1 where score >= 0.4)) group by gene_id, session""")
def peak_sessions(v: Views) -> DataFrame:
    return rounded(windows.peaks(v.pos1, ["gene_id"], "score", 0.4, 20), "peak_score")


@query("""select chrom, min(start) as start, max("end") as "end", cast(count(*) as bigint) as n from (select *, sum(fresh) over (partition by chrom order by start, "end", id) as island from (
  select *, case when start <= max("end") over (partition by chrom order by start, "end", id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from intervals)) group by chrom, island""")
def merge_intervals(v: Views) -> DataFrame:
    return windows.merge_intervals(v.intervals.select("chrom", "start", "end"), ["chrom"])


@query("""select order_id, line_id, near_marked from (select *, count(*) filter (where pred_type <> 'TN') over (partition by gene_id order by position range between 5 preceding and 5 following) > 0 as near_marked from positions) where pred_type = 'TN'""")
def neighbour_flag(v: Views) -> DataFrame:
    rows = windows.near_flag(v.positions.select("order_id", "line_id", "gene_id", "position", "pred_type"), ["gene_id"], F.col("pred_type") != "TN", 5)
    return rows.filter("pred_type = 'TN'").select("order_id", "line_id", "near_marked")


@query("""select gene_id, cast(max(k) as bigint) as k, cast(sum(case when r <= k then t else 0 end) as bigint) as hits from (select *, row_number() over (partition by gene_id order by donor_score desc, order_id, line_id, transcript_id, position) as r, sum(t) over (partition by gene_id) as k from (select *, cast(coalesce(splice_type = 'donor', false) as int) as t from positions)) where k > 0 group by gene_id""")
def topk_per_gene(v: Views) -> DataFrame:
    return metrics.top_k(v.positions, ["gene_id"], F.coalesce(F.col("splice_type") == "donor", F.lit(False)), "donor_score", ["order_id", "line_id", "transcript_id", "position"])


@query("select gene_id, cast(count(*) filter (where pred_type = 'FP') as bigint) as n_fp from positions group by gene_id order by n_fp desc, gene_id limit 20")
def top_error_genes(v: Views) -> DataFrame:
    return v.positions.groupBy("gene_id").agg(F.count_if(F.col("pred_type") == "FP").alias("n_fp")).orderBy(F.col("n_fp").desc(), "gene_id").limit(20)


@query("""select gene_id, round(f1_score, 6) as f1_score, FP from (select gene_id, avg(f1) as f1_score, cast(sum(fp) as bigint) as FP from (select gene_id, strand, coalesce(2.0 * count(*) filter (where pred_type = 'TP') / nullif(2 * count(*) filter (where pred_type = 'TP') + count(*) filter (where pred_type in ('FP', 'FN')), 0), 0) as f1, count(*) filter (where pred_type = 'FP') as fp from positions group by 1, 2) group by 1)
  where f1_score <= 0.6 order by FP desc, f1_score, gene_id limit 10""")
def hard_genes(v: Views) -> DataFrame:
    return rounded(metrics.hard_groups(metrics.confusion(v.positions, ["gene_id", "strand"]), ["gene_id"], most=0.6), "f1_score")


@query("""select gene_id, donor_pos, acceptor_pos, round(mean_score, 6) as mean_score from (select d.gene_id, d.position as donor_pos, a.position as acceptor_pos, (d.score + a.score) / 2 as mean_score, row_number() over (partition by d.gene_id, d.position order by a.position) as near
  from pos1 d join pos1 a on d.gene_id = a.gene_id and d.splice_type = 'donor' and a.splice_type = 'acceptor' and a.position > d.position) where near <= 3 qualify row_number() over (partition by gene_id, donor_pos order by mean_score desc, acceptor_pos) = 1""")
def knn_junctions(v: Views) -> DataFrame:
    s = v.pos1.filter("splice_type is not null").select("gene_id", "position", F.col("splice_type").alias("site_type"), "score")
    return rounded(sites.best_acceptors(s, ["gene_id"], 3), "mean_score")


_GREEDY = """gs as (select gene_id, position, splice_type, score from pos1 where splice_type is not null and score >= 0.3),
gd as (select gene_id, position, row_number() over (partition by gene_id order by score desc, position) as i from gs where splice_type = 'donor'),
gt as (select gene_id, cast(0 as bigint) as i, cast(null as bigint) as donor_pos, cast(null as bigint) as acceptor_pos, list(position) as free from gs where splice_type = 'acceptor' group by gene_id
  union all select gene_id, i, p, a, list_filter(free, lambda x: a is null or x <> a) from (select gt.gene_id, d.i, d.position as p, list_min(list_filter(gt.free, lambda x: x > d.position)) as a, gt.free from gt join gd d on d.gene_id = gt.gene_id and d.i = gt.i + 1))"""


@query("select gene_id, donor_pos, acceptor_pos from gt where acceptor_pos is not null", _GREEDY, recursive=True)
def greedy_junctions(v: Views) -> DataFrame:
    s = v.pos1.filter("splice_type is not null").select("gene_id", "position", F.col("splice_type").alias("site_type"), "score")
    return sites.greedy_junctions(s, ["gene_id"], 0.3)


_PEAKS = """pk as (select *, row_number() over (partition by gene_id order by score desc, n) as i from (
  select gene_id, position, score, row_number() over w as n, lag(score) over w as before, lead(score) over w as after from pos1 window w as (partition by gene_id order by position)) where score >= 0.5 and before < score and after < score),
pt as (select distinct gene_id, cast(0 as bigint) as i, cast(null as bigint) as n, cast([] as bigint[]) as kept from pk
  union all select gene_id, i, case when ok then n end, case when ok then list_append(kept, n) else kept end from (select p.gene_id, p.i, p.n, pt.kept, len(list_filter(pt.kept, lambda x: abs(x - p.n) < 10)) = 0 as ok from pt join pk p on p.gene_id = pt.gene_id and p.i = pt.i + 1)),
pr as (select gene_id, position, score, row_number() over (partition by gene_id order by position) as n from pos1),
pl as (select k.gene_id, k.position, k.score, k.n,
  coalesce((select max(o.n) from pr o where o.gene_id = k.gene_id and o.n < k.n and o.score > k.score), 0) as low_n, coalesce((select min(o.n) from pr o where o.gene_id = k.gene_id and o.n > k.n and o.score > k.score), 1000000000) as high_n from pk k join pt on pt.gene_id = k.gene_id and pt.n = k.n)"""


@query("""select gene_id, position, score from pl where score - greatest(coalesce((select min(o.score) from pr o where o.gene_id = pl.gene_id and o.n > low_n and o.n < pl.n), score), coalesce((select min(o.score) from pr o where o.gene_id = pl.gene_id and o.n < high_n and o.n > pl.n), score)) >= 0.1""", _PEAKS, recursive=True)
def score_peaks(v: Views) -> DataFrame:
    return peak_tracks.score_peaks(v.pos1.select("gene_id", "position", "score"), ["gene_id"])


@query("""select gene_id, a.position - d.position as intron_length, d.position as donor_pos, a.position as acceptor_pos from pos1 d join pos1 a using (gene_id) where d.splice_type = 'donor' and a.splice_type = 'acceptor' and a.position > d.position and a.position - d.position <= 300""")
def short_junctions(v: Views) -> DataFrame:
    s = v.pos1.filter("splice_type is not null").select("gene_id", "position", F.col("splice_type").alias("site_type"))
    return sites.all_junctions(s, ["gene_id"], 300)


_EASY = """easy_rows as (
  select *, pred_type = 'TN' and greatest(donor_score, acceptor_score) < 0.3 and not near as easy from (select *, count(*) filter (where pred_type <> 'TN') over (partition by gene_id order by position range between 3 preceding and 3 following) > 0 as near from positions)
), numbered as (
  select *, row_number() over (partition by easy order by md5('42|' || order_id || '|' || line_id || '|' || transcript_id || '|' || position), order_id, line_id, transcript_id, position) as k from easy_rows
)"""


@query("select order_id, line_id, gene_id, transcript_id, position, pred_type from easy_rows where not easy", _EASY, name="tn_downsample_kept")
def tn_downsample_none(v: Views) -> DataFrame:
    """No easy negatives at all."""
    return _thinned(v, 0.0)


@query("select order_id, line_id, gene_id, transcript_id, position, pred_type from numbered where not easy or k <= cast(floor((select count(*) from positions where pred_type <> 'TN') * 0.05) as bigint)", _EASY)
def tn_downsample(v: Views) -> DataFrame:
    """Exactly a twentieth as many easy negatives as there are other rows."""
    return _thinned(v, 0.05)


@query("select order_id, line_id, gene_id, transcript_id, position, pred_type from numbered where not easy or k <= (select count(*) from positions where pred_type <> 'TN')", _EASY)
def tn_downsample_even(v: Views) -> DataFrame:
    """As many easy negatives as there are other rows, or all."""
    return _thinned(v, 1.0)


def _thinned(v: Views, ratio: float) -> DataFrame:
    rows = sampling.thin_negatives(v.positions, ["gene_id"], ["order_id", "line_id", "transcript_id", "position"], hard=0.3, radius=3, ratio=ratio)
    return rows.select("order_id", "line_id", "gene_id", "transcript_id", "position", "pred_type")


@query("select gene_id, gene_type from genes qualify row_number() over (partition by gene_type order by md5('42|' || gene_id), gene_id) <= 2")
def stratified_sample(v: Views) -> DataFrame:
    return sampling.sample_strata(v.genes.select("gene_id", "gene_type"), ["gene_type"], ["gene_id"], n=2)


@query("select gene_id, gene_type from genes qualify row_number() over (partition by gene_type order by md5('7|' || gene_id), gene_id) <= least(greatest(floor(count(*) over (partition by gene_type) * 0.3), 1), 5)")
def proportional_sample(v: Views) -> DataFrame:
    return sampling.sample_strata(v.genes.select("gene_id", "gene_type"), ["gene_type"], ["gene_id"], share=0.3, least=1, most=5, seed=7)


@query("""select p.gene_id, cast(count(*) as bigint) as n from positions p where gene_id in (select gene_id from (select gene_id, sum(n) over (order by md5('42|' || gene_id), gene_id) as so_far from (select gene_id, count(*) as n from positions group by 1)) where so_far <= 1000) group by 1""")
def whole_gene_cap(v: Views) -> DataFrame:
    return sampling.sample_groups(v.positions, "gene_id", 1000).groupBy("gene_id").agg(F.count("*").alias("n"))


@query("select gene_id from genes order by md5('42|' || gene_id), gene_id limit 3")
def gene_sample(v: Views) -> DataFrame:
    return sampling.sample_rows(v.genes.select("gene_id"), 3, ["gene_id"])


@query("select split, cast(count(*) as bigint) as n from (select case when transcript_id in (1) then 'test' when transcript_id in (5, 10) then 'val' else 'train' end as split from positions) group by split")
def chrom_split(v: Views) -> DataFrame:
    return v.positions.groupBy(sampling.chromosome_split(F.col("transcript_id").cast("string")).alias("split")).agg(F.count("*").alias("n"))


@query("select fold, cast(count(*) as bigint) as n_genes from (select cast(('0x' || substr(md5('42|' || gene_id), 1, 8))::bigint % 5 as bigint) as fold from genes) group by fold")
def gene_folds(v: Views) -> DataFrame:
    return v.genes.groupBy(sampling.fold_of("gene_id", 5).alias("fold")).agg(F.count("*").alias("n_genes"))


@query("""select transcript_id, strand, exon_rank, site_type, position from (select *, count(*) over (partition by transcript_id) as n, row_number() over (partition by transcript_id order by case when strand = '+' then start else -start end, case when strand = '+' then "end" else -"end" end) as exon_rank from exons) e,
  lateral (select 'acceptor' as site_type, case when strand = '+' then start - 1 else "end" + 1 end as position where exon_rank > 1 union all select 'donor', case when strand = '+' then "end" + 1 else start - 1 end where exon_rank < n) where n >= 2""")
def exon_to_sites(v: Views) -> DataFrame:
    return sites.exon_sites(v.exons).select("transcript_id", "strand", "exon_rank", "site_type", "position")


@query("select gene_id, 'x' as tag, cast(count(*) as bigint) as n, max(position) as last_position from (select gene_id, position from positions order by gene_id, position) group by gene_id")
def first_last(v: Views) -> DataFrame:
    rows = windows.first_rows(v.positions.select("gene_id", "position"), ["gene_id"], [F.col("position").desc()])
    n = v.positions.groupBy("gene_id").agg(F.count("*").alias("n"))
    return longs(tables.first_of_each(rows, ["gene_id"], [F.col("position").desc()]).join(n, "gene_id"), "n").select("gene_id", F.lit("x").alias("tag"), "n", F.col("position").alias("last_position"))
