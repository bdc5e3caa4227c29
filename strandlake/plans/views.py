"""The domain's tables, as views of the driver's: for Spark, and as SQL for the comparison."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores

ACGT = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def _days(col: str) -> F.Column:
    return F.datediff(F.col(col), F.lit("1995-01-01").cast("date")).cast("long")


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def positions(self) -> DataFrame:
        """Predictions: (gene_id, transcript_id, position) with scores, splice type and prediction type; keys repeat."""
        d, a = F.col("l_discount") * 5, F.col("l_tax") * 6.25
        site, pred = F.col("splice_type").isNotNull(), F.col("pred")
        rows = self.table("lineitem").select(
            F.col("l_partkey").alias("gene_id"),
            F.col("l_suppkey").alias("transcript_id"),
            _days("l_shipdate").alias("position"),
            F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
            d.alias("donor_score"),
            a.alias("acceptor_score"),
            (F.lit(1.0) - d - a).alias("neither_score"),
            F.when(F.col("l_returnflag") == "R", "donor").when(F.col("l_returnflag") == "A", "acceptor").alias("splice_type"),
            (F.col("l_quantity") >= 25).alias("pred"),
            (F.col("l_quantity") / 50).alias("score"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").cast("long").alias("line_id"),
        )
        return rows.withColumn("pred_type", F.when(site & pred, "TP").when(site, "FN").when(pred, "FP").otherwise("TN"))

    @cached_property
    def pos1(self) -> DataFrame:
        """One row for each (gene_id, position)."""
        rows = self.positions.groupBy("gene_id", "position").agg(
            F.max("donor_score").alias("donor_score"), F.max("acceptor_score").alias("acceptor_score"), F.min("strand").alias("strand"), F.min("splice_type").alias("splice_type"), F.max("score").alias("score")
        )
        return rows.withColumn("neither_score", F.lit(1.0) - F.col("donor_score") - F.col("acceptor_score"))

    @cached_property
    def context(self) -> DataFrame:
        """pos1 with the neighbours of the donor score."""
        from ..operators.windows import with_context

        return with_context(self.pos1, ["gene_id"], "donor_score")

    @cached_property
    def genes(self) -> DataFrame:
        spans = self.positions.groupBy("gene_id").agg(F.min("position").alias("start"), F.max("position").alias("end"))
        part = self.table("part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_type").alias("gene_type"), F.col("p_size").cast("long").alias("size"))
        return part.join(spans, "gene_id").withColumn("gene_length", F.col("end") - F.col("start") + 1)

    @cached_property
    def intervals(self) -> DataFrame:
        """(id, chrom, strand, start, end) of orders; chrom is the customer."""
        start = _days("o_orderdate")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chrom"), F.when(F.col("o_orderstatus") == "O", "+").otherwise("-").alias("strand"), start.alias("start"), (start + F.floor(F.col("o_totalprice") / 5000)).alias("end"))

    @cached_property
    def exons(self) -> DataFrame:
        """Intervals as exons of a transcript, the customer."""
        return self.intervals.select("id", F.col("chrom").alias("transcript_id"), F.when(F.col("chrom") % 2 == 0, "+").otherwise("-").alias("strand"), "start", "end", (F.col("end") - F.col("start") + 1).alias("exon_length"))

    @cached_property
    def seqs(self) -> DataFrame:
        """(id, sequence): the lower-case letters of whole documents, as nucleotides."""
        return self.table("documents").select(F.col("doc_id").alias("id"), F.translate(F.regexp_replace("text", "[^a-z]+", ""), *ACGT).alias("sequence"))

    @cached_property
    def attrs(self) -> DataFrame:
        text = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), F.col("p_name"), F.lit('"; gene_biotype "'), F.col("p_type"), F.lit('";'))
        return self.table("part").select(F.col("p_partkey").alias("id"), text.alias("attribute"))

    @cached_property
    def variants(self) -> DataFrame:
        def base(k: str) -> F.Column:
            return F.expr(f"substr('ACGT', cast(pmod({k}, 4) as int) + 1, 1)")

        ref = F.concat(base("l_partkey"), F.when(F.col("l_linenumber") % 3 == 0, base("l_orderkey")).otherwise(""))
        alt = F.concat(base("l_partkey + l_linenumber"), F.when(F.col("l_linenumber") % 4 == 0, base("l_suppkey")).otherwise(""))
        sign = F.when(F.col("l_linestatus") == "O", "+").otherwise("-")
        rows = self.table("lineitem")
        return rows.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_id"), F.col("l_suppkey").cast("string").alias("CHROM"), F.col("l_partkey").alias("POS"), ref.alias("ref"), alt.alias("alt"),
            F.concat(F.lit("c."), F.col("l_partkey").cast("string"), sign, F.col("l_quantity").cast("int").cast("string"), F.lit("A>G")).alias("hgvs"),
            F.concat(F.lit("AF="), F.format_string("%.2f", F.col("l_discount")), F.lit(";CLNSIG="), F.when(F.col("l_returnflag") == "R", "Pathogenic").when(F.col("l_returnflag") == "A", "Likely_benign").otherwise("Uncertain_significance")).alias("info"),
            F.col("l_quantity").alias("qual"), F.when(F.col("l_tax") < 0.04, "PASS").otherwise("q10").alias("filter"), F.col("l_discount").alias("af"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        """(gene_id, position, site_type, score, flags): events as sites, in order of time."""
        w = F.row_number().over(_by_user())
        rows = self.table("events").select(F.col("user_id").alias("gene_id"), (w * 7).cast("long").alias("position"), (F.col("value") / 400).alias("score"), "event_type", "event_id")
        return rows.select("gene_id", "position", F.when(F.col("event_id") % 2 == 0, "donor").otherwise("acceptor").alias("site_type"), "score", (F.col("event_id") % 3 > 0).alias("is_canonical"), (F.col("event_id") % 5 < 3).alias("is_suppressed"), (F.col("event_id") % 5 >= 3).alias("is_activated"))

    def derived(self) -> DataFrame:
        """positions with the derived probabilities."""
        return self.positions.withColumns(scores.derived_probabilities(F.col("donor_score"), F.col("acceptor_score"), F.col("neither_score")))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


SQL = f"""
positions as (
  select *, case when splice_type is not null and pred then 'TP' when splice_type is not null then 'FN' when pred then 'FP' else 'TN' end as pred_type
  from (
    select l_partkey as gene_id, l_suppkey as transcript_id, cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as bigint) as position,
      case when l_linestatus = 'O' then '+' else '-' end as strand, l_discount * 5 as donor_score, l_tax * 6.25 as acceptor_score,
      1.0::double - l_discount * 5 - l_tax * 6.25 as neither_score,
      case l_returnflag when 'R' then 'donor' when 'A' then 'acceptor' end as splice_type, l_quantity >= 25 as pred, l_quantity / 50 as score,
      l_orderkey as order_id, cast(l_linenumber as bigint) as line_id
    from lineitem)
), pos1 as (
  select *, 1.0::double - donor_score - acceptor_score as neither_score from (
    select gene_id, position, max(donor_score) as donor_score, max(acceptor_score) as acceptor_score, min(strand) as strand, min(splice_type) as splice_type, max(score) as score
    from positions group by all)
), context as (
  select *, coalesce(lag(donor_score, 2) over w, 0) as m2, coalesce(lag(donor_score, 1) over w, 0) as m1,
    coalesce(lead(donor_score, 1) over w, 0) as p1, coalesce(lead(donor_score, 2) over w, 0) as p2
  from pos1 window w as (partition by gene_id order by position)
), genes as (
  select p_partkey as gene_id, p_name as gene_name, p_type as gene_type, cast(p_size as bigint) as size, s.start, s."end", s."end" - s.start + 1 as gene_length
  from part join (select gene_id, min(position) as start, max(position) as "end" from positions group by gene_id) s on p_partkey = s.gene_id
), intervals as (
  select *, start + cast(floor(price / 5000) as bigint) as "end" from (
    select o_orderkey as id, o_custkey as chrom, case when o_orderstatus = 'O' then '+' else '-' end as strand,
      cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as start, o_totalprice as price from orders)
), exons as (
  select id, chrom as transcript_id, case when chrom % 2 = 0 then '+' else '-' end as strand, start, "end", "end" - start + 1 as exon_length from intervals
), seqs as (
  select doc_id as id, translate(regexp_replace(text, '[^a-z]', '', 'g'), '{ACGT[0]}', '{ACGT[1]}') as sequence from documents
), attrs as (
  select p_partkey as id, 'gene_id "G' || p_partkey || '"; gene_name "' || p_name || '"; gene_biotype "' || p_type || '";' as attribute from part
), variants as (
  select l_orderkey as order_id, cast(l_linenumber as bigint) as line_id, cast(l_suppkey as varchar) as CHROM, l_partkey as POS,
    substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) || case when l_linenumber % 3 = 0 then substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1) else '' end as ref,
    substr('ACGT', cast((l_partkey + l_linenumber) % 4 as int) + 1, 1) || case when l_linenumber % 4 = 0 then substr('ACGT', cast(l_suppkey % 4 as int) + 1, 1) else '' end as alt,
    'c.' || l_partkey || case when l_linestatus = 'O' then '+' else '-' end || cast(l_quantity as int) || 'A>G' as hgvs,
    'AF=' || printf('%.2f', l_discount) || ';CLNSIG=' || case l_returnflag when 'R' then 'Pathogenic' when 'A' then 'Likely_benign' else 'Uncertain_significance' end as info,
    l_quantity as qual, case when l_tax < 0.04 then 'PASS' else 'q10' end as filter, l_discount as af
  from lineitem
), sites as (
  select user_id as gene_id, cast(row_number() over (partition by user_id order by ts, event_id) * 7 as bigint) as position,
    case when event_id % 2 = 0 then 'donor' else 'acceptor' end as site_type, value / 400 as score,
    event_id % 3 > 0 as is_canonical, event_id % 5 < 3 as is_suppressed, event_id % 5 >= 3 as is_activated
  from events
)
"""


def with_views(body: str, more: str = "", recursive: bool = False) -> str:
    """SQL over the views; more holds further common tables, of which some may be recursive.

    Where recursion is allowed, a union takes the types of its first part, so it is only where it is needed.
    """
    return f"with {'recursive ' if recursive else ''}{SQL.strip()}{', ' + more if more else ''}\n{body}"
