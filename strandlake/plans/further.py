"""Further queries: checks, comparisons, selections, encodings, and variants' scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords, scores
from ..operators import adapters, joins, metrics, sampling, tables, validate, windows
from ..schemas import POSITIONS
from .registry import longs, query, rounded
from .views import Views


@query("""select rule, n, round(n / t, 6) as share from (select cast(count(*) as bigint) as t, cast(count(*) filter (where not (donor_score between 0 and 1)) as bigint) as a, cast(count(*) filter (where neither_score < 0) as bigint) as b, cast(count(*) filter (where splice_type is null) as bigint) as c from positions), lateral (values ('donor_in_range', a), ('neither_in_range', b), ('has_type', c)) v(rule, n)""")
def rule_violations(v: Views) -> DataFrame:
    rules = {"donor_in_range": F.col("donor_score").between(0, 1), "neither_in_range": F.col("neither_score") >= 0, "has_type": F.col("splice_type").isNotNull()}
    return rounded(validate.violations(v.positions, rules), "share")


@query("select p_partkey as gene_id from part where p_partkey not in (select gene_id from positions where splice_type = 'donor' group by 1 having count(*) >= 10)")
def genes_without_sites(v: Views) -> DataFrame:
    return validate.missing_keys(v.table("part").select(F.col("p_partkey").alias("gene_id")), v.positions.filter("splice_type = 'donor'"), "gene_id", 10)


@query("""select feature, round(s, 6) as shift, abs(s) > 3 as drifted from (select 'donor_score' as feature, (avg(donor_score) filter (where strand = '-') - avg(donor_score) filter (where strand = '+')) / stddev_samp(donor_score) filter (where strand = '+') as s from positions
  union all select 'score', (avg(score) filter (where strand = '-') - avg(score) filter (where strand = '+')) / stddev_samp(score) filter (where strand = '+') from positions)""")
def feature_drift(v: Views) -> DataFrame:
    p = v.positions
    return rounded(validate.feature_drift(p.filter("strand = '+'"), p.filter("strand = '-'"), ["donor_score", "score"]), "shift")


@query("""select splice_type as site_type, cast(count(*) as bigint) as n, round(avg(case when (splice_type = 'donor' and (w like '%GT%' or w like '%GC%')) or (splice_type = 'acceptor' and w like '%AG%') then 1.0 else 0 end), 6) as share
  from (select p.splice_type, substr(s.sequence, cast(greatest(p.position - 3, 0) + 1 as int), cast(greatest(least(p.position + 3, length(s.sequence)) - greatest(p.position - 3, 0), 0) as int)) as w from pos1 p join seqs s on p.gene_id = s.id where p.position >= 0 and p.splice_type is not null) group by 1""")
def consensus_share(v: Views) -> DataFrame:
    from ..functions.sequences import window_slice

    rows = v.pos1.filter("position >= 0 and splice_type is not null").join(v.seqs, F.col("gene_id") == F.col("id"))
    rows = rows.select(F.col("splice_type").alias("site_type"), window_slice(F.col("sequence"), F.col("position"), 3).alias("window"))
    return rounded(validate.motif_share(rows), "share")


@query("select order_id, line_id, POS as pos, ref, substr(sequence, cast(POS as int), length(ref)) = ref as matches from variants left join seqs on POS = id")
def reference_matches(v: Views) -> DataFrame:
    rows = v.variants.select("order_id", "line_id", F.col("POS").alias("pos"), "ref")
    return validate.reference_matches(rows.withColumn("id", F.col("pos")), v.seqs, "id").drop("id")


@query("select gene_id, cast(count(distinct s) as bigint) as n_sources from (select gene_id, strand as s from positions) group by 1 having count(distinct s) >= 2")
def split_overlap(v: Views) -> DataFrame:
    return validate.overlap_free({"train": v.positions.filter("strand = '+'"), "test": v.positions.filter("strand = '-'")}, "gene_id")


@query("select transcript_id, gene_id from positions where pred_type in ('TP', 'FP') group by all having count(distinct case pred_type when 'FP' then 1 else 0 end) = 2")
def both_labels(v: Views) -> DataFrame:
    label = F.when(F.col("pred_type") == "FP", 1).otherwise(0)
    return v.positions.filter("pred_type in ('TP', 'FP')").groupBy("transcript_id", "gene_id").agg(F.countDistinct(label).alias("n")).filter("n = 2").select("transcript_id", "gene_id")


@query("""select gene_id, cast(count(*) as bigint) as total, cast(count(*) filter (where splice_type = 'donor') as bigint) as donors, cast(count(*) filter (where splice_type = 'acceptor') as bigint) as acceptors, cast(count(*) filter (where pred_type = 'TP') as bigint) as TP, cast(count(*) filter (where pred_type = 'FN') as bigint) as FN,
  round(100.0 * count(*) filter (where pred_type = 'TP') / count(*), 6) as tp_percent from positions group by gene_id""")
def site_counts(v: Views) -> DataFrame:
    t, p = F.col("splice_type"), F.col("pred_type")
    rows = v.positions.groupBy("gene_id").agg(F.count("*").alias("total"), F.count_if(t == "donor").alias("donors"), F.count_if(t == "acceptor").alias("acceptors"), F.count_if(p == "TP").alias("TP"), F.count_if(p == "FN").alias("FN"))
    return rounded(rows.withColumn("tp_percent", 100.0 * F.col("TP") / F.col("total")), "tp_percent")


@query("""select gene_id, round(b, 6) as f1_base, round(m, 6) as f1_meta, round(m - b, 6) as delta from (select gene_id, coalesce(2.0 * count(*) filter (where s and d >= 0.25) / nullif(count(*) filter (where s) + count(*) filter (where d >= 0.25), 0), 0) as b, coalesce(2.0 * count(*) filter (where s and x >= 0.25) / nullif(count(*) filter (where s) + count(*) filter (where x >= 0.25), 0), 0) as m
  from (select gene_id, splice_type is not null as s, donor_score as d, score as x from positions) group by 1)""")
def compare_performance(v: Views) -> DataFrame:
    site = F.col("splice_type").isNotNull()

    def f1(col: str, name: str) -> DataFrame:
        hit = F.col(col) >= 0.25
        kind = F.when(site & hit, "TP").when(site, "FN").when(hit, "FP").otherwise("TN")
        return metrics.confusion(v.positions.withColumn("pred_type", kind), ["gene_id"]).select("gene_id", F.col("f1_score").alias(name))

    both = f1("donor_score", "f1_base").join(f1("score", "f1_meta"), "gene_id", "full").fillna(0.0)
    return rounded(both.withColumn("delta", F.col("f1_meta") - F.col("f1_base")), "f1_base", "f1_meta", "delta")


@query("""select gene_id, threshold, round(f1, 6) as f1_score from (select gene_id, k / 20.0::double as threshold, coalesce(2.0 * count(*) filter (where s and x >= k / 20.0) / nullif(count(*) filter (where s) + count(*) filter (where x >= k / 20.0), 0), 0) as f1
  from (select gene_id, splice_type is not null as s, greatest(donor_score, acceptor_score) as x from positions), range(2, 18) r(k) group by 1, 2) qualify row_number() over (partition by gene_id order by f1 desc, threshold) = 1""")
def gene_thresholds(v: Views) -> DataFrame:
    site, best = F.col("splice_type").isNotNull(), F.greatest("donor_score", "acceptor_score")
    counts = [F.count_if(site).alias("sites")]
    for k in range(2, 18):
        counts += [F.count_if(site & (best >= k / 20)).alias(f"tp{k}"), F.count_if(best >= k / 20).alias(f"pp{k}")]
    rows = v.positions.groupBy("gene_id").agg(*counts)
    f1 = F.array(*(F.struct(F.coalesce(F.try_divide(2.0 * F.col(f"tp{k}"), F.col("sites") + F.col(f"pp{k}")), F.lit(0.0)).alias("f1"), F.lit(-k / 20).alias("minus")) for k in range(2, 18)))
    return rounded(rows.select("gene_id", F.array_max(f1).alias("b")).select("gene_id", (-F.col("b.minus")).alias("threshold"), F.col("b.f1").alias("f1_score")), "f1_score")


@query("""select gene_id, position, case when p2 and a <= 0.1 then 'donor' when p3 and a > 0.1 then 'acceptor' else 'neither' end as view from (select gene_id, position, donor_score > 0.1 and donor_score >= acceptor_score and donor_score >= neither_score as p2, acceptor_score > 0.1 and acceptor_score >= donor_score and acceptor_score >= neither_score as p3,
  case when acceptor_score > 0.1 and acceptor_score >= donor_score and acceptor_score >= neither_score then 1 else 0 end as a from pos1)""")
def adjusted_view(v: Views) -> DataFrame:
    d, a, n = F.col("donor_score"), F.col("acceptor_score"), F.col("neither_score")
    acceptor, donor = (a > 0.1) & (a >= d) & (a >= n), (d > 0.1) & (d >= a) & (d >= n)
    return v.pos1.select("gene_id", "position", F.when(acceptor, "acceptor").when(donor, "donor").otherwise("neither").alias("view"))


@query("select gene_id, cast(rank() over (order by n desc) as bigint) as by_count, cast(rank() over (order by s desc) as bigint) as by_score from (select gene_id, count(*) as n, round(sum(score), 6) as s from positions group by 1)")
def rank_columns(v: Views) -> DataFrame:
    rows = v.positions.groupBy("gene_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("s"))
    out = rows.select("gene_id", F.rank().over(Window.orderBy(F.col("n").desc())).alias("by_count"), F.rank().over(Window.orderBy(F.col("s").desc())).alias("by_score"))
    return longs(out, "by_count", "by_score")


@query("select coalesce(a.f, b.f, c.f) as feature, a.r as r1, b.r as r2, c.r as r3 from (select p_partkey as f, p_size as r from part where p_partkey % 2 = 0) a full join (select p_partkey as f, p_size + 1 as r from part where p_partkey % 3 = 0) b on a.f = b.f full join (select p_partkey as f, p_size + 2 as r from part where p_partkey % 5 = 0) c on coalesce(a.f, b.f) = c.f")
def merge_rankings(v: Views) -> DataFrame:
    part = v.table("part")

    def ranking(k: int, add: int, name: str) -> DataFrame:
        return part.filter(F.col("p_partkey") % k == 0).select(F.col("p_partkey").alias("feature"), (F.col("p_size") + add).alias(name))

    return ranking(2, 0, "r1").join(ranking(3, 1, "r2"), "feature", "full").join(ranking(5, 2, "r3"), "feature", "full")


@query("""select id, gene_id, gene_name from (select i.id, g.gene_id, g.gene_name from intervals i join genes g on i.chrom = g.gene_id and i.start between g.start and g."end")""")
def point_in_interval(v: Views) -> DataFrame:
    points = v.intervals.select("id", F.col("chrom").alias("gene_id"), F.col("start").alias("position"))
    g = v.genes.select("gene_id", "gene_name", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    return points.join(g, "gene_id").filter(F.col("position").between(F.col("g_start"), F.col("g_end"))).select("id", "gene_id", "gene_name")


@query("select gene_id, position, pred_type from pos1 join (select gene_id, position, min(pred_type) as pred_type from positions group by 1, 2) using (gene_id, position) where pred_type <> 'FP' or not exists (select 1 from intervals i where i.chrom = pos1.gene_id and pos1.position between i.start and i.\"end\")")
def suppressed_errors(v: Views) -> DataFrame:
    types = v.positions.groupBy("gene_id", "position").agg(F.min("pred_type").alias("pred_type"))
    spans = v.intervals.select(F.col("chrom").alias("gene_id"), F.col("id").alias("transcript_id"), "start", "end")
    found = joins.containing(types, spans, ["gene_id"], bin_width=200)
    return found.filter((F.col("pred_type") != "FP") | F.col("transcript_id").isNull()).select("gene_id", "position", "pred_type")


@query("""select order_id, line_id, case when donor_score >= acceptor_score and donor_score >= neither_score then 'donor' when acceptor_score >= neither_score then 'acceptor' else 'neither' end as called from positions""")
def argmax_call(v: Views) -> DataFrame:
    return v.positions.select("order_id", "line_id", scores.best_of({k: F.col(f"{k}_score") for k in ("donor", "acceptor", "neither")}).alias("called"))


@query("select id, chrom, start, \"end\", case when strand = '+' then 5 else \"end\" - 1 - start - 5 end as at from intervals")
def window_index(v: Views) -> DataFrame:
    return v.intervals.select("id", "chrom", "start", "end", coords.window_index(F.col("start"), F.col("end"), F.col("start") + 5, F.col("strand")).alias("at"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_field(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.from_json("props", "map<string,int>")["k"].cast("long").alias("k"))


@query("select gene_id, gene_type, gene_length from genes where gene_length >= 1000 qualify row_number() over (partition by case when gene_length < 2000 then 0 else 1 end order by md5('42|' || gene_id), gene_id) <= 5")
def length_strata(v: Views) -> DataFrame:
    rows = v.genes.filter("gene_length >= 1000").withColumn("stratum", F.when(F.col("gene_length") < 2000, 0).otherwise(1))
    return sampling.sample_strata(rows, ["stratum"], ["gene_id"], n=5).select("gene_id", "gene_type", "gene_length")


@query("""select gene_id, cast(s as bigint) as points from (select gene_id, case when gene_length >= 2000 then 2 else 0 end + case when n >= 30 then 1 else 0 end as s from (select gene_id, count(*) as n from positions group by 1) join genes using (gene_id)) order by s desc, gene_id limit 15""")
def meta_optimised(v: Views) -> DataFrame:
    n = v.positions.groupBy("gene_id").agg(F.count("*").alias("n"))
    points = F.when(F.col("gene_length") >= 2000, 2).otherwise(0) + F.when(F.col("n") >= 30, 1).otherwise(0)
    rows = n.join(v.genes.select("gene_id", "gene_length"), "gene_id").select("gene_id", points.cast("long").alias("points"))
    return rows.orderBy(F.col("points").desc(), "gene_id").limit(15)


@query("select gene_id, position, round(score, 6) as score, round(donor_score, 6) as donor_score, round(acceptor_score, 6) as acceptor_score, round(neither_score, 6) as neither_score from (select cast(gene_id as varchar) as gene_id, position, greatest(donor_score, acceptor_score) as score, donor_score, acceptor_score, neither_score from positions)")
def adapt_scores(v: Views) -> DataFrame:
    raw = v.positions.select("gene_id", F.col("position").alias("absolute_position"), F.col("donor_score").alias("donor_prob"), F.col("acceptor_score").alias("acceptor_prob"))
    out = adapters.adapt(raw, "nested_scores", POSITIONS)
    return rounded(out.select("gene_id", "position", "score", "donor_score", "acceptor_score", "neither_score"), "score", "donor_score", "acceptor_score", "neither_score")


@query("""select cast(d as bigint) as dist_limit, cast(count(*) filter (where g.gene_length - p.position < d) as bigint) as n from pos1 p join genes g using (gene_id), (values (500), (1000)) v(d) group by d""")
def distance_limits(v: Views) -> DataFrame:
    rows = v.pos1.join(v.genes.select("gene_id", "gene_length"), "gene_id")
    left = F.col("gene_length") - F.col("position")
    one = rows.agg(*(F.count_if(left < d).alias(f"n{d}") for d in (500, 1000)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("dist_limit"), F.col(f"n{d}").alias("n")) for d in (500, 1000)))).alias("x")).select("x.*")


@query("""select gene_id, position, round(coalesce(d, m + 500), 6) as distance, cast(d is not null as int) as has_distance from (select gene_id, position, case when splice_type is not null then position - 1 end as d, max(case when splice_type is not null then position - 1 end) over () as m from pos1)""")
def sentinel_distance(v: Views) -> DataFrame:
    d = F.when(F.col("splice_type").isNotNull(), F.col("position") - 1)
    most = v.pos1.agg(F.max(d).alias("most"))
    rows = v.pos1.crossJoin(F.broadcast(most))
    return rows.select("gene_id", "position", F.round(F.coalesce(d, F.col("most") + 500).cast("double"), 6).alias("distance"), d.isNotNull().cast("int").alias("has_distance"))


@query("select strand, pred_type, cast(count(*) as bigint) as n from (select * from positions where pred_type <> 'TN' union all (select * from positions where pred_type = 'TN' order by md5('42|' || order_id || '|' || line_id || '|' || gene_id || '|' || transcript_id || '|' || position), order_id, line_id, gene_id, transcript_id, position limit 500)) group by all")
def negative_budget(v: Views) -> DataFrame:
    keys = ["order_id", "line_id", "gene_id", "transcript_id", "position"]
    kept = v.positions.filter("pred_type != 'TN'").unionByName(sampling.sample_rows(v.positions.filter("pred_type = 'TN'"), 500, keys))
    return kept.groupBy("strand", "pred_type").agg(F.count("*").alias("n"))


@query("select strand, gene_id, cast(max(position) as bigint) as last_position, cast(count(*) as bigint) as n from pos1 group by all having count(*) >= 3")
def group_summary(v: Views) -> DataFrame:
    rows = v.pos1.groupBy("strand", "gene_id").agg(F.max("position").alias("last_position"), F.count("*").alias("n"))
    return rows.filter("n >= 3").select("strand", "gene_id", "last_position", "n")


@query("""select gene_id, position, score from (select gene_id, position, round(score, 6) as score from pos1) qualify row_number() over (partition by gene_id order by score desc, position) <= 3""")
def best_positions(v: Views) -> DataFrame:
    rows = v.pos1.select("gene_id", "position", F.round("score", 6).alias("score"))
    return windows.first_rows(rows, ["gene_id"], [F.col("score").desc(), F.col("position")], 3)


@query("select gene_id, strand, cast(count(*) as bigint) as n from (select distinct gene_id, strand, position from positions) group by all")
def distinct_positions(v: Views) -> DataFrame:
    return tables.first_of_each(v.positions.select("gene_id", "strand", "position"), ["gene_id", "strand", "position"], [F.col("position")]).groupBy("gene_id", "strand").agg(F.count("*").alias("n"))
