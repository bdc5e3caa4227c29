"""Queries of column functions: features, sequences, coordinates, variants, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coords, scores, sequences, variants
from ..operators import metrics, tables
from ..sources.annotation import with_attributes
from ..sources.variants import with_splice_impact
from .registry import longs, query, r6, rounded
from .views import Views


def _dan() -> tuple[Column, Column, Column]:
    """The donor, acceptor and neither scores."""
    return F.col("donor_score"), F.col("acceptor_score"), F.col("neither_score")


@query("""select id, nullif(regexp_extract(attribute, 'gene_id "([^"]*)"', 1), '') as gene_id, nullif(regexp_extract(attribute, 'gene_name "([^"]*)"', 1), '') as gene_name,
  nullif(regexp_extract(attribute, 'gene_biotype "([^"]*)"', 1), '') as gene_type, cast(null as varchar) as transcript_id from attrs""")
def scan_gtf_attributes(v: Views) -> DataFrame:
    return with_attributes(v.attrs).select("id", "gene_id", "gene_name", "gene_type", "transcript_id")


@query("""select gene_id, position, round((m2 + m1 + p1 + p2) / 4, 6) as context_neighbor_mean, round((m1 + m2) - (p1 + p2), 6) as context_asymmetry, round(greatest(m2, m1, p1, p2), 6) as context_max from context""")
def context_features(v: Views) -> DataFrame:
    return v.context.select("gene_id", "position", *r6(**scores.context_features()))


def _site_sql(kind: str) -> str:
    s = f"{kind}_score"
    parts = {
        "diff_m1": f"{s} - m1", "diff_m2": f"{s} - m2", "diff_p1": f"{s} - p1", "diff_p2": f"{s} - p2",
        "surge_ratio": f"log10({s} / (m1 + p1 + 1e-10) + 1)", "weighted_context": f"0.1 * m2 + 0.2 * m1 + 0.4 * {s} + 0.2 * p1 + 0.1 * p2",
        "peak_height_ratio": f"log10({s} / ((m2 + m1 + p1 + p2) / 4 + 1e-10) + 1)", "second_derivative": f"2 * {s} - m1 - p1", "signal_strength": f"{s} - (m2 + m1 + p1 + p2) / 4",
        "context_diff_ratio": f"log10({s} / (greatest(m2, m1, p1, p2) + 1e-10) + 1)",
    }
    cols = ", ".join(f"round({x}, 4) as {kind}_{k}" for k, x in parts.items())
    return f"select gene_id, position, {cols}, cast({s} > m1 and {s} > p1 and {s} > 0.001 as int) as {kind}_is_local_peak from context"


def _site(v: Views, kind: str) -> DataFrame:
    # Ratios over a near-zero denominator are compared by their logarithm.
    wide = ("surge_ratio", "peak_height_ratio", "context_diff_ratio")
    features = {k: (F.log10(c + 1) if k.endswith(wide) else c) for k, c in scores.site_features(kind).items()}
    return v.context.select("gene_id", "position", *(c.alias(k) if k.endswith("peak") else F.round(c, 4).alias(k) for k, c in features.items()))


@query(_site_sql("donor"))
def donor_features(v: Views) -> DataFrame:
    return _site(v, "donor")


@query(_site_sql("acceptor"))
def acceptor_features(v: Views) -> DataFrame:
    return _site(v, "acceptor")


@query("""select gene_id, position, round(d - mean - (a - mean), 6) as type_signal_difference, round((d - a) / (d + a + 1e-10), 6) as score_difference_ratio,
  round(case when abs(mean) > 0.01 then (d / (mean + 1e-10)) / (a / (mean + 1e-10) + 1e-10) end, 4) as donor_acceptor_peak_ratio
  from (select gene_id, position, donor_score as d, acceptor_score as a, (m2 + m1 + p1 + p2) / 4 as mean from context) where a > 0.01""")
def cross_features(v: Views) -> DataFrame:
    rows = v.context.filter("acceptor_score > 0.01").withColumns({**scores.site_features("donor"), **scores.site_features("acceptor"), **scores.context_features()}).withColumns(scores.cross_features())
    ratio = F.when(F.abs("context_neighbor_mean") > 0.01, F.col("donor_acceptor_peak_ratio"))
    return rows.select("gene_id", "position", *r6(type_signal_difference=F.col("type_signal_difference"), score_difference_ratio=F.col("score_difference_ratio")), F.round(ratio, 4).alias("donor_acceptor_peak_ratio"))


@query("""select order_id, line_id, gene_id, position, round(donor_score / (donor_score + acceptor_score + 1e-10), 6) as relative_donor_probability,
  round((donor_score + acceptor_score) / (donor_score + acceptor_score + neither_score + 1e-10), 6) as splice_probability,
  round((donor_score - acceptor_score) / (greatest(donor_score, acceptor_score) + 1e-10), 6) as donor_acceptor_diff,
  round((greatest(donor_score, acceptor_score) - neither_score) / (greatest(donor_score, acceptor_score, neither_score) + 1e-10), 6) as splice_neither_diff,
  round(ln(donor_score + 1e-10) - ln(acceptor_score + 1e-10), 6) as donor_acceptor_logodds
  from positions""")
def derived_probability(v: Views) -> DataFrame:
    names = ("relative_donor_probability", "splice_probability", "donor_acceptor_diff", "splice_neither_diff", "donor_acceptor_logodds")
    return v.derived().select("order_id", "line_id", "gene_id", "position", *(F.round(n, 6).alias(n) for n in names))


@query("""select order_id, line_id, gene_id, position, round(-(donor_score * ln(donor_score + 1e-10) + acceptor_score * ln(acceptor_score + 1e-10) + neither_score * ln(neither_score + 1e-10)), 6) as probability_entropy,
  round(ln(donor_score + acceptor_score + 1e-10) - ln(neither_score + 1e-10), 6) as splice_neither_logodds from positions where neither_score > 0.001""")
def probability_entropy(v: Views) -> DataFrame:
    return rounded(v.derived().filter("neither_score > 0.001").select("order_id", "line_id", "gene_id", "position", "probability_entropy", "splice_neither_logodds"), "probability_entropy", "splice_neither_logodds")


@query("select order_id, line_id, round(donor_score - acceptor_score, 6) as donor_acceptor_diff, round(donor_score + acceptor_score - neither_score, 6) as splice_neither_diff from positions")
def inference_differences(v: Views) -> DataFrame:
    return v.positions.select("order_id", "line_id", *r6(**scores.inference_differences(*_dan())))


def _uncertain(entropy: str, spread: str, high: str) -> str:
    return f"(site >= 0.02 and site < {high}) or score_entropy > {entropy} or score_spread < {spread} or score_variance > 0.08"


_UNCERTAIN = """doubts as (
  select *, greatest(d, a) as site, case when t > 0 then (e(d) + e(a) + e(n)) / ln(3.0) else 0 end as score_entropy, best - (t - best - least(d, a, n)) as score_spread,
    ((d - t / 3) * (d - t / 3) + (a - t / 3) * (a - t / 3) + (n - t / 3) * (n - t / 3)) / 3 as score_variance
  from (select gene_id, position, donor_score as d, acceptor_score as a, neither_score as n, donor_score + acceptor_score + neither_score as t, greatest(donor_score, acceptor_score, neither_score) as best from pos1)
)"""
for _x in "dan":
    _UNCERTAIN = _UNCERTAIN.replace(f"e({_x})", f"-greatest({_x} / t, 1e-10) * ln(greatest({_x} / t, 1e-10))")


@query(f"""select gene_id, position, round(site, 6) as max_score, round(score_entropy, 6) as score_entropy, round(score_spread, 6) as score_spread, round(score_variance, 6) as score_variance, {_uncertain('0.6', '0.2', '0.8')} as is_uncertain,
  concat_ws(';', case when site >= 0.02 and site < 0.8 then 'confidence_zone' end, case when score_entropy > 0.6 then 'high_entropy(' || printf('%.3f', round(score_entropy, 3)) || ')' end,
    case when score_spread < 0.2 then 'low_spread(' || printf('%.3f', round(score_spread, 3)) || ')' end, case when score_variance > 0.08 then 'high_variance(' || printf('%.3f', round(score_variance, 3)) || ')' end) as reasons from doubts""", _UNCERTAIN)
def uncertainty(v: Views) -> DataFrame:
    u = scores.uncertainty(*_dan())
    return v.pos1.select("gene_id", "position", *r6(**{k: u[k] for k in ("max_score", "score_entropy", "score_spread", "score_variance")}), u["is_uncertain"].alias("is_uncertain"), u["reasons"].alias("reasons"))


@query(f"""select entropy::double as entropy, spread::double as spread, high::double as high, round(rate, 6) as rate from (
  select entropy, spread, high, avg(case when {_uncertain('entropy', 'spread', 'high')} then 1.0 else 0 end) as rate from doubts, (values (0.4), (0.5), (0.6), (0.7), (0.8)) e(entropy), (values (0.1), (0.15), (0.2), (0.25), (0.3)) s(spread), (values (0.7), (0.75), (0.8), (0.85), (0.9)) h(high) group by all)
  order by round(abs(rate - 0.6), 12), 1, 2, 3 limit 1""", _UNCERTAIN)
def adaptive_thresholds(v: Views) -> DataFrame:
    """The limits of the grid whose share of uncertain positions is closest to six in ten."""
    return rounded(metrics.tune_uncertainty(v.pos1, *_dan(), target=0.6), "rate")


@query("""select k as threshold, cast(count(*) filter (where greatest(donor_score, acceptor_score) >= k / 10.0 and greatest(donor_score, acceptor_score) < 0.8) as bigint) as n
  from positions, range(0, 8) r(k) group by k""")
def threshold_grid(v: Views) -> DataFrame:
    best = F.greatest("donor_score", "acceptor_score")
    one = v.positions.agg(*(F.count_if((best >= F.lit(k) / 10.0) & (best < 0.8)).alias(f"n{k}") for k in range(8)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("threshold"), F.col(f"n{k}").alias("n")) for k in range(8)))).alias("x")).select("x.*")


@query("""select order_id, line_id, round(greatest(d, a, n, s), 6) as ds_max, case greatest(d, a, n, s) when d then 'DS_AG' when a then 'DS_AL' when n then 'DS_DG' else 'DS_DL' end as event
  from (select order_id, line_id, abs(donor_score) as d, abs(acceptor_score) as a, abs(neither_score) as n, abs(score) as s from positions)""")
def dsmax_event(v: Views) -> DataFrame:
    d, a, n = _dan()
    most, name = scores.largest_delta({"DS_AG": d, "DS_AL": a, "DS_DG": n, "DS_DL": F.col("score")})
    return v.positions.select("order_id", "line_id", F.round(most, 6).alias("ds_max"), name.alias("event"))


@query("""select p.gene_id, p.position, case when strand = '+' then p.position - g.start else g."end" - p.position end as offset0, case when strand = '+' then p.position - g.start else g."end" - p.position end + 1 as relative, p.position as back
  from pos1 p join genes g using (gene_id)""")
def coord_roundtrip(v: Views) -> DataFrame:
    rows = v.pos1.join(v.genes.select("gene_id", "start", "end"), "gene_id")
    args = (F.col("start"), F.col("end"), F.col("strand"))
    rel = coords.to_relative(F.col("position"), *args)
    return rows.select("gene_id", "position", coords.offset0(F.col("position"), *args).alias("offset0"), rel.alias("relative"), coords.to_absolute(rel, *args).alias("back"))


@query("""select i.id, g.gene_id, case when i.start >= g.start and i."end" <= g."end" then 'within' when i."end" < g.start or i.start > g."end" then 'no_overlap' else 'partial' end as status
  from intervals i join genes g on i.chrom = g.gene_id""")
def boundary_status(v: Views) -> DataFrame:
    g = v.genes.select("gene_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    rows = v.intervals.join(g, F.col("chrom") == F.col("gene_id"))
    return rows.select("id", "gene_id", coords.boundary_status(F.col("g_start"), F.col("g_end"), F.col("start"), F.col("end")).alias("status"))


@query("""select CHROM as chrom, cast(count(*) as bigint) as n, cast(min(case when cast(CHROM as int) between 1 and 22 then cast(CHROM as int) else 100 end) as bigint) as code from variants group by CHROM""")
def chromosome_codes(v: Views) -> DataFrame:
    rows = v.variants.select(F.concat(F.lit("chr"), "CHROM").alias("c"))
    return rows.groupBy(coords.chrom_name(F.col("c")).alias("chrom")).agg(F.count("*").alias("n"), F.min(coords.chrom_code(F.col("c"))).cast("long").alias("code"))


@query("""select kmer, cast(count(*) as bigint) as n from (select unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) as kmer from seqs where length(sequence) >= 3) group by kmer""")
def kmer_counts(v: Views) -> DataFrame:
    return v.seqs.select(F.explode(sequences.kmer_bag(F.col("sequence"), 3)).alias("kmer")).filter(sequences.valid_kmer(F.col("kmer"))).groupBy("kmer").agg(F.count("*").alias("n"))


@query("select id, round(case when length(sequence) > 0 then (length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence) else 0 end, 6) as gc, cast(length(sequence) as bigint) as length from seqs")
def gc_content(v: Views) -> DataFrame:
    return v.seqs.select("id", F.round(sequences.gc_content(F.col("sequence")), 6).alias("gc"), F.length("sequence").cast("long").alias("length"))


@query("""select id, round(-(p(a) + p(c) + p(g) + p(t)), 6) as entropy from (select id, n(A) as a, n(C) as c, n(G) as g, n(T) as t from (select id, sequence as s, length(sequence) as l from seqs) where l > 0)"""
    .replace("p(a)", "case when a > 0 then a * log2(a) else 0 end").replace("p(c)", "case when c > 0 then c * log2(c) else 0 end").replace("p(g)", "case when g > 0 then g * log2(g) else 0 end").replace("p(t)", "case when t > 0 then t * log2(t) else 0 end")
    .replace("n(A)", "(l - length(replace(s, 'A', ''))) / l").replace("n(C)", "(l - length(replace(s, 'C', ''))) / l").replace("n(G)", "(l - length(replace(s, 'G', ''))) / l").replace("n(T)", "(l - length(replace(s, 'T', ''))) / l"))
def seq_entropy(v: Views) -> DataFrame:
    return v.seqs.filter("sequence != ''").select("id", F.round(sequences.entropy(F.col("sequence")), 6).alias("entropy"))


@query("select id, md5(reverse(translate(sequence, 'ACGTN', 'TGCAN'))) as digest from seqs")
def revcomp(v: Views) -> DataFrame:
    return v.seqs.select("id", F.md5(sequences.reverse_complement(F.col("sequence"))).alias("digest"))


@query("""select id, cast(len(starts) as bigint) as n_gt, cast(list_min(starts) as bigint) as first_gt, cast(list_sum(starts) as bigint) as sum_gt
  from (select id, list_filter(range(0, length(sequence) - 1), lambda i: substr(sequence, i + 1, 2) = 'GT') as starts from seqs where length(sequence) >= 2)""")
def motif_scan(v: Views) -> DataFrame:
    rows = v.seqs.filter("length(sequence) >= 2").select("id", sequences.motif_starts(F.col("sequence"), "GT").alias("s"))
    return rows.select("id", F.size("s").cast("long").alias("n_gt"), F.array_min("s").cast("long").alias("first_gt"), F.when(F.size("s") > 0, F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)).alias("sum_gt"))


@query("""select id, cast(len(hits) as bigint) as n_hits, cast(list_sum(hits) as bigint) as sum_starts from (select id, list_filter(range(0, length(sequence) - 2), lambda i: substr(sequence, i + 1, 3) in ('CAT', 'CGT')) as hits from seqs where length(sequence) >= 3)""")
def pattern_scan(v: Views) -> DataFrame:
    rows = v.seqs.filter("length(sequence) >= 3").select("id", sequences.pattern_matches("sequence", "C[AG]T").alias("m"))
    return rows.select("id", F.size("m").cast("long").alias("n_hits"), F.when(F.size("m") > 0, F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["start"])).alias("sum_starts"))


@query("""select id, md5(string_agg(kmer, ',' order by i)) as in_order from (select id, i, substr(sequence, i, 4) as kmer from (select id, sequence, unnest(range(1, length(sequence) - 2)) as i from seqs where length(sequence) >= 4)) group by id""")
def ordered_kmers(v: Views) -> DataFrame:
    return v.seqs.filter("length(sequence) >= 4").select("id", F.md5(F.array_join(sequences.kmers(F.col("sequence"), 4), ",")).alias("in_order"))


@query("""select id, round(-sum(p * log2(p)), 6) as entropy from (select id, count(*) / sum(count(*)) over (partition by id) as p from (select doc_id as id, unnest(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), '')) as c from documents) where c <> '' group by id, c) group by id""")
def letter_entropy(v: Views) -> DataFrame:
    rows = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text")).filter(F.col("text").rlike("[a-zA-Z ]")).select("id", F.regexp_replace("text", "[^a-zA-Z ]+", "").alias("s"))
    return rows.select("id", F.round(sequences.composition_entropy(F.col("s")), 6).alias("entropy"))


@query("""select id, w as window_no, round((length(s) - length(translate(s, 'GC', ''))) / 50.0, 6) as gc from (
  select id, cast(unnest(range(0, length(sequence) // 50)) as bigint) as w, substr(sequence, unnest(range(0, length(sequence) // 50)) * 50 + 1, 50) as s from seqs where length(sequence) >= 50)""")
def tumbling_kmers(v: Views) -> DataFrame:
    rows = v.seqs.select("id", F.posexplode(sequences.tumbling(F.col("sequence"), 50)).alias("w", "s"))
    return rows.select("id", F.col("w").cast("long").alias("window_no"), F.round(sequences.gc_content(F.col("s")), 6).alias("gc"))


@query("""select p.gene_id, p.position, substr(s.sequence, cast(greatest(p.position - 10, 0) + 1 as int), cast(greatest(least(p.position + 10, length(s.sequence)) - greatest(p.position - 10, 0), 0) as int)) as slice
  from pos1 p join seqs s on p.gene_id = s.id where p.position >= 0""")
def window_slice(v: Views) -> DataFrame:
    rows = v.pos1.filter("position >= 0").select("gene_id", "position").join(v.seqs, F.col("gene_id") == F.col("id"))
    return rows.select("gene_id", "position", sequences.window_slice(F.col("sequence"), F.col("position"), 10).alias("slice"))


@query("""select p.gene_id, p.position, repeat('N', greatest(3 - p.position, 0)) || substr(s.sequence, greatest(p.position - 3, 0) + 1, p.position + 4 - greatest(p.position - 3, 0)) || repeat('N', greatest(p.position + 4 - length(s.sequence), 0)) as padded
  from pos1 p join seqs s on p.gene_id = s.id where p.position >= 0 and p.position < length(s.sequence)""")
def padded_window(v: Views) -> DataFrame:
    rows = v.pos1.filter("position >= 0").select("gene_id", "position").join(v.seqs, F.col("gene_id") == F.col("id")).filter(F.col("position") < F.length("sequence"))
    return rows.select("gene_id", "position", sequences.padded_window(F.col("sequence"), F.col("position"), 3).alias("padded"))


@query("""select order_id, line_id, regexp_extract(hgvs, '([cg])\\.', 1) as level, cast(regexp_extract(hgvs, 'c\\.(\\d+)', 1) as bigint) as base, cast(regexp_extract(hgvs, '([+-]\\d+)', 1) as bigint) as intronic,
  'A' as ref, 'G' as alt, 'sub' as change, case when abs(cast(regexp_extract(hgvs, '([+-]\\d+)', 1) as bigint)) > 20 then null when hgvs like '%+%' then 'donor' else 'acceptor' end as site_type from variants""")
def hgvs_parse(v: Views) -> DataFrame:
    h = variants.hgvs(F.col("hgvs"))
    return v.variants.select("order_id", "line_id", *(c.alias(k) for k, c in h.items()), variants.intronic_site(h["intronic"]).alias("site_type"))


@query("""select site, confidence, cast(count(*) as bigint) as n from (select case when o > 0 and o <= 10 then 'donor' when o < 0 and o >= -25 then 'acceptor' else 'deep_intronic' end as site,
  case when abs(o) <= 2 then 'high' when (o > 0 and o <= 10) or (o < 0 and o >= -25) then 'medium' else 'low' end as confidence from (select cast(regexp_extract(hgvs, '([+-]\\d+)', 1) as bigint) as o from variants)) group by all""")
def hgvs_site_hint(v: Views) -> DataFrame:
    site, trust = variants.site_hint(variants.hgvs(F.col("hgvs"))["intronic"])
    return v.variants.select(site.alias("site"), trust.alias("confidence")).groupBy("site", "confidence").agg(F.count("*").alias("n"))


_TRIM = """t1 as (
  select order_id, line_id, POS, case when substr(ref, 1, 2) = substr(alt, 1, 2) and length(ref) > 1 and length(alt) > 1 then 2 when substr(ref, 1, 1) = substr(alt, 1, 1) then 1 else 0 end as p, ref, alt from variants
), t2 as (select order_id, line_id, POS, substr(ref, p + 1) as r, substr(alt, p + 1) as a from t1
), t3 as (select *, case when length(r) = 0 or length(a) = 0 then 0 when length(r) > 1 and length(a) > 1 and r = a then 2 when right(r, 1) = right(a, 1) then 1 else 0 end as q from t2
), trimmed as (select order_id, line_id, POS, coalesce(nullif(substr(r, 1, length(r) - q), ''), '-') as ref, coalesce(nullif(substr(a, 1, length(a) - q), ''), '-') as alt from t3)"""


@query("""select order_id, line_id, ref, alt, case when ref <> '-' and alt <> '-' and length(ref) = 1 and length(alt) = 1 then 'SNV' when ref = '-' then 'insertion' when alt = '-' then 'deletion' else 'indel' end as kind from trimmed""", _TRIM)
def allele_trim(v: Views) -> DataFrame:
    ref, alt = variants.trim_alleles(F.col("ref"), F.col("alt"))
    rows = v.variants.select("order_id", "line_id", ref.alias("ref"), alt.alias("alt"))
    return rows.withColumn("kind", variants.variant_class(F.col("ref"), F.col("alt")))


@query("""select case when length(ref) = 1 and length(alt) = 1 then 'SNV' when length(ref) > length(alt) then 'deletion' when length(ref) < length(alt) then 'insertion' else 'complex' end as variant_type, cast(count(*) as bigint) as n from variants group by 1""")
def variant_class(v: Views) -> DataFrame:
    return v.variants.groupBy(variants.record_class(F.col("ref"), F.col("alt")).alias("variant_type")).agg(F.count("*").alias("n"))


@query("select order_id, line_id, regexp_extract(info, 'CLNSIG=([^;]*)', 1) as clnsig, cast(regexp_extract(info, 'AF=([^;]*)', 1) as double) as af from variants")
def info_map(v: Views) -> DataFrame:
    m = variants.info_map(F.col("info"))
    return v.variants.select("order_id", "line_id", m["CLNSIG"].alias("clnsig"), m["AF"].cast("double").alias("af"))


_REVIEW = "case l_linenumber when 1 then 'Reviewed by expert panel' when 2 then 'criteria provided, multiple submitters, no conflicts' when 3 then 'criteria provided, single submitter' when 4 then 'practice guideline; single submitter' when 5 then 'no assertion criteria' end"


@query(f"select l_orderkey as order_id, cast(l_linenumber as bigint) as line_id, case l_linenumber when 1 then 3 when 2 then 2 when 3 then 1 when 4 then 4 else 0 end as stars from lineitem where case l_linenumber when 1 then 3 when 2 then 2 when 3 then 1 when 4 then 4 else 0 end >= 1")
def review_confidence(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_id"), variants.review_stars(F.expr(_REVIEW)).alias("stars"))
    return rows.filter("stars >= 1")


@query("select order_id, line_id from (select l_orderkey as order_id, cast(l_linenumber as bigint) as line_id, case l_linenumber % 3 when 0 then 'Splice_Donor_Variant&intron_variant' when 1 then 'missense_variant' else 'not_splice_donor_variant' end as c from lineitem) where lower(c) like 'splice_donor_variant%'")
def splice_consequences(v: Views) -> DataFrame:
    c = F.expr("case l_linenumber % 3 when 0 then 'Splice_Donor_Variant&intron_variant' when 1 then 'missense_variant' else 'not_splice_donor_variant' end")
    rows = v.table("lineitem").filter(variants.affects_splicing(c, ("splice_donor_variant", "splice_acceptor_variant")))
    return rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_id"))


@query("""select significance, cast(count(*) as bigint) as n from (select case when info like '%Pathogenic%' then 'pathogenic' when info like '%enign%' then 'benign' else 'uncertain' end as significance from variants) group by 1""")
def significance(v: Views) -> DataFrame:
    return v.variants.groupBy(variants.first_contained(F.col("info"), variants.SIGNIFICANCE, "other").alias("significance")).agg(F.count("*").alias("n"))


@query("""select stage, n from (select cast(count(*) as bigint) as s0, cast(count(*) filter (where a) as bigint) as s1, cast(count(*) filter (where a and b) as bigint) as s2, cast(count(*) filter (where a and b and c) as bigint) as s3, cast(count(*) filter (where a and b and c and d) as bigint) as s4
  from (select abs(cast(regexp_extract(hgvs, '([+-]\\d+)', 1) as int)) <= 20 as a, info like '%Pathogenic%' as b, af <= 0.05 as c, qual >= 10 and filter = 'PASS' as d from variants)), (values ('all', 0), ('splice', 1), ('pathogenic', 2), ('frequency', 3), ('quality', 4)) s(stage, k), lateral (select case k when 0 then s0 when 1 then s1 when 2 then s2 when 3 then s3 else s4 end as n)""")
def filter_cascade_counts(v: Views) -> DataFrame:
    stages = {
        "splice": variants.intronic_site(variants.hgvs(F.col("hgvs"))["intronic"]).isNotNull(),
        "pathogenic": variants.first_contained(F.col("info"), variants.SIGNIFICANCE, "other") == "pathogenic",
        "frequency": F.col("af").isNull() | (F.col("af") <= 0.05),
        "quality": (F.col("qual").isNull() | (F.col("qual") >= 10)) & (F.col("filter").isNull() | F.col("filter").isin("PASS", ".", "")),
    }
    return tables.stage_counts(v.variants, stages)


@query("""select splice_mechanism, splice_confidence, cast(count(*) as bigint) as n from (
  select ['direct_splice_site', 'exonic_boundary_effect', 'polypyrimidine_tract_effect', 'intronic_cryptic_site', 'exonic_ese_ess_effect', 'exonic_extended_region', 'utr_regulatory_effect', 'structural_splice_effect', 'indirect_splice_effect', 'keyword_based_detection', 'none', 'direct_splice_site'][p + 1] as splice_mechanism,
    ['high', 'high', 'high', 'medium', 'low', 'low', 'low', 'low', 'low', 'low', 'none', 'high'][p + 1] as splice_confidence
  from (select POS % 12 as p from variants)) group by all""")
def splice_mechanism(v: Views) -> DataFrame:
    texts = ["MC=SO:0001575", "MC=Splice_Region_variant|missense_variant", "so:0001629,intron_variant", "stop_lost|SO:0001627", "synonymous_variant|5_prime_UTR_variant", "splice_donor_5th_base_variant|inframe_insertion", "3_prime_utr_variant", "SO:0001821", "Start_Lost", "branch_point", "AF=0.1", "intron_variant&splice_acceptor_variant"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.pmod("POS", F.lit(len(texts))) + 1).cast("int"))
    rows = with_splice_impact(v.variants.withColumn("so", text), F.col("so"), F.lit("."))
    return rows.groupBy("splice_mechanism", "splice_confidence").agg(F.count("*").alias("n"))


@query("""select gene_id, position, splice_type, donor_score, acceptor_score from (select gene_id, position, splice_type, round(donor_score, 6) as donor_score, cast(null as double) as acceptor_score from pos1 where splice_type = 'donor'
  union all select gene_id, position, splice_type, null, round(acceptor_score, 6) from pos1 where splice_type = 'acceptor')""")
def schema_align_union(v: Views) -> DataFrame:
    donors = v.pos1.filter("splice_type = 'donor'").select("gene_id", "position", "splice_type", F.round("donor_score", 6).alias("donor_score"))
    acceptors = v.pos1.filter("splice_type = 'acceptor'").select("gene_id", "position", "splice_type", F.round("acceptor_score", 6).alias("acceptor_score"), F.lit(1).alias("extra"))
    target = T.StructType([T.StructField("gene_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("splice_type", T.StringType()), T.StructField("donor_score", T.DoubleType()), T.StructField("acceptor_score", T.DoubleType())])
    return tables.ensure(tables.stack(donors, acceptors), target)


@query("select gene_id, gene_type, cast(dense_rank() over (order by gene_type) - 1 as bigint) as code from genes")
def encode_ordinal(v: Views) -> DataFrame:
    return longs(tables.ordinal(v.genes.select("gene_id", "gene_type"), "gene_type", "code"), "code").select("gene_id", "gene_type", "code")


@query("""select order_id, line_id, coalesce(splice_type, 'unknown') as splice_type, round(coalesce(nullif(donor_score, 0), (select median(nullif(donor_score, 0)) from positions)), 6) as donor_score from positions""")
def impute_median(v: Views) -> DataFrame:
    rows = v.positions.select("order_id", "line_id", "splice_type", F.nullif(F.col("donor_score"), F.lit(0.0)).alias("donor_score"))
    return rounded(tables.fill_nulls(rows, ["splice_type", "donor_score"]), "donor_score")


@query("""select 'splice_type' as "column", round(avg(case when splice_type is null then 1.0 else 0 end), 6) as share from positions""")
def null_shares(v: Views) -> DataFrame:
    return rounded(tables.null_shares(v.positions.select("gene_id", "splice_type", "donor_score")), "share")


@query("select case splice_type when 'donor' then 1 when 'acceptor' then 2 else 0 end as label, cast(count(*) as bigint) as n from positions group by 1")
def label_codes(v: Views) -> DataFrame:
    return v.positions.groupBy(tables.label_code().alias("label")).agg(F.count("*").alias("n"))


@query("select order_id, line_id, strand, splice_type from positions where strand = '+' and splice_type in ('donor', 'acceptor')")
def subset_conditions(v: Views) -> DataFrame:
    return tables.select_where(v.positions, {"strand": "+", "splice_type": ["donor", "acceptor"]}).select("order_id", "line_id", "strand", "splice_type")


@query("select cast(count(*) filter (where abs(donor_score + acceptor_score + neither_score - 1) > 0.01) as bigint) as bad, cast(count(*) as bigint) as n from positions")
def probability_coherence(v: Views) -> DataFrame:
    return v.positions.agg(F.count_if(~coords.probability_ok(*_dan())).alias("bad"), F.count("*").alias("n"))


@query("""select cast(count(*) filter (where p.position < g.start or p.position > g."end") as bigint) as outside, cast(count(*) as bigint) as n from positions p join genes g using (gene_id)""")
def position_range_check(v: Views) -> DataFrame:
    rows = v.positions.select("gene_id", "position").join(v.genes.select("gene_id", "start", "end"), "gene_id")
    return rows.agg(F.count_if(~F.col("position").between(F.col("start"), F.col("end"))).alias("outside"), F.count("*").alias("n"))


@query("""select gene_id, case when n < 30 then 'few' when n < 60 then 'some' else 'many' end as bucket, cast(n as bigint) as n, round(n / gene_length * 1000, 6) as density from (select gene_id, count(*) as n from positions group by 1) join genes using (gene_id)""")
def gene_characteristics(v: Views) -> DataFrame:
    n = v.positions.groupBy("gene_id").agg(F.count("*").alias("n"))
    rows = n.join(v.genes.select("gene_id", "gene_length"), "gene_id")
    bucket = F.when(F.col("n") < 30, "few").when(F.col("n") < 60, "some").otherwise("many")
    return rows.select("gene_id", bucket.alias("bucket"), "n", F.round(F.col("n") / F.col("gene_length") * 1000, 6).alias("density"))
