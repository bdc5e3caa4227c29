"""Queries over files: each writes the driver's rows in a format, reads the files back, and is compared with SQL over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import annotation, bgzip, variants
from .registry import query, rounded
from .views import Views


def _gtf_lines(v: Views) -> DataFrame:
    """Genes and, for each, its two halves as exons of one transcript."""
    g = v.genes.select("gene_id", "gene_name", "gene_type", F.col("start"), F.col("end"), F.when(F.col("gene_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    names = F.format_string('gene_id "G%d"; gene_name "%s"; gene_biotype "%s";', "gene_id", "gene_name", "gene_type")
    middle = F.floor((F.col("start") + F.col("end")) / 2)

    def row(feature: str, start, end, more: str):
        return F.struct(F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), F.concat(names, F.format_string(more, "gene_id")).alias("attribute"))

    exon = ' transcript_id "T%d.1"; exon_number "{0}"; exon_id "E{0}";'
    each = F.explode(F.array(row("gene", F.col("start"), F.col("end"), ' tag "%d";'), row("transcript", F.col("start"), F.col("end"), ' transcript_id "T%d.1";'), row("exon", F.col("start"), middle, exon.format(1)), row("exon", middle, F.col("end"), exon.format(2))))
    rows = g.select("strand", each.alias("x"))
    return rows.select(F.concat_ws("\t", F.lit("chr1"), F.lit("test"), "x.feature", F.col("x.start").cast("string"), F.col("x.end").cast("string"), F.lit("."), "strand", F.lit("."), "x.attribute").alias("value"))


def _gtf(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "gtf")
    _gtf_lines(v).write.text(path)
    return annotation.read_gtf(v.spark, path)


@query("""select 'G' || gene_id as gene_id, gene_name, gene_type, start, "end", case when gene_id % 2 = 0 then '+' else '-' end as strand, "end" - start + 1 as gene_length from genes""")
def gtf_genes(v: Views) -> DataFrame:
    return annotation.genes(_gtf(v)).select("gene_id", "gene_name", "gene_type", "start", "end", "strand", "gene_length")


@query("""select 'T' || gene_id as transcript_id, 'G' || gene_id as gene_id, "end" - start + 1 as transcript_length from genes""")
def gtf_transcripts(v: Views) -> DataFrame:
    return annotation.transcripts(_gtf(v)).select("transcript_id", "gene_id", "transcript_length")


@query("""select 'G' || gene_id as gene_id, k as exon_number, case k when 1 then cast(floor((start + "end") / 2) as bigint) - start else "end" - cast(floor((start + "end") / 2) as bigint) end + 1 as exon_length from genes, (values (1), (2)) e(k)""")
def gtf_exons(v: Views) -> DataFrame:
    return annotation.exons(_gtf(v)).select("gene_id", "exon_number", "exon_length")


@query("""select feature, cast(count(*) as bigint) as n from (select unnest(['gene', 'transcript', 'exon', 'exon']) as feature from genes) where feature = 'exon' group by feature""")
def gtf_parts(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "gtf-table")
    annotation.save_gtf(_gtf(v), path)
    return annotation.parts(v.spark.read.parquet(path)).groupBy("feature").agg(F.count("*").alias("n"))


@query("""select id, substr(sequence, 51, 100) as piece, reverse(translate(substr(sequence, 11, 30), 'ACGT', 'TGCA')) as back from seqs where length(sequence) >= 150""")
def fasta_slices(v: Views) -> DataFrame:
    path, width = scratch_dir(v.spark, "fasta"), 60
    lines = F.concat(F.lit(">s"), F.col("id").cast("string"), F.lit(" of a table\n"), F.array_join(F.regexp_extract_all("sequence", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n"))
    v.seqs.filter("sequence != ''").select(lines.alias("value")).write.text(path)
    pieces = annotation.read_fasta(v.spark, path)
    whole = v.seqs.filter("length(sequence) >= 150").select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("chrom"))

    def cut(start: int, end: int, strand: str, name: str) -> DataFrame:
        spans = whole.select("id", "chrom", F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), F.lit(strand).alias("strand"))
        return annotation.slices(pieces, spans, ["id"], width).select("id", F.col("sequence").alias(name))

    return cut(51, 150, "+", "piece").join(cut(11, 40, "-", "back"), "id")


@query("""select CHROM as chrom, POS as pos, ref, alt, regexp_extract(info, 'AF=([^;]*)', 1) as "INFO_AF", regexp_extract(info, 'CLNSIG=(.*)', 1) as "INFO_CLNSIG", filter,
  case when length(ref) = 1 and length(alt) = 1 then 'SNV' when length(ref) > length(alt) then 'deletion' when length(ref) < length(alt) then 'insertion' else 'complex' end as variant_type from variants""")
def vcf_records(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "vcf")
    rows = v.variants.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.lit(None).cast("string").alias("id"), "ref", "alt", "qual", "filter", "info")
    variants.write_vcf(rows, path)
    return variants.read_vcf(v.spark, path, ["AF", "CLNSIG"]).select("chrom", "pos", "ref", "alt", "INFO_AF", "INFO_CLNSIG", "filter", "variant_type")


@query("""select CHROM as chrom, POS as pos, a as alt from variants, (values ('G'), ('TT')) k(a)""")
def vcf_alternatives(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "vcf")
    rows = v.variants.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.lit("x").alias("id"), "ref", F.lit("G,TT").alias("alt"), "qual", "filter", "info")
    variants.write_vcf(rows, path)
    return variants.read_vcf(v.spark, path).select("chrom", "pos", "alt")


@query("""select 'track name="errors" itemRgb="On"' as line, cast(1 as bigint) as n union all select concat_ws('\t', 'chr' || transcript_id, position - 1, position, gene_id, 0, strand, case pred_type when 'FP' then '255,0,0' when 'FN' then '0,0,255' else '0,0,0' end), cast(count(*) as bigint) from positions group by 1""")
def bed_lines(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "bed")
    rows = v.positions.select(F.concat(F.lit("chr"), F.col("transcript_id").cast("string")).alias("chrom"), "position", "gene_id", "strand", "pred_type")
    annotation.write_bed(rows, path, "errors")
    return v.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("""select concat_ws('\t', 'chr' || transcript_id, position - 1, position, gene_id, cast(round(score * 1000) as int), strand) as line, cast(count(*) as bigint) as n from positions where score >= 0.9 group by 1""")
def bed_calls(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "bed")
    rows = v.positions.select(F.concat(F.lit("chr"), F.col("transcript_id").cast("string")).alias("chrom"), "position", "gene_id", "strand", "score")
    annotation.write_calls(rows, path, "calls", "score", 0.9)
    return v.spark.read.text(path).filter("value not like 'track%'").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("""select 'chr' || gene_id as chrom, position, round(score, 6) as score from pos1 where splice_type = 'donor'""")
def bedgraph_scores(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "bedgraph")
    rows = v.pos1.select(F.concat(F.lit("chr"), F.col("gene_id").cast("string")).alias("chrom"), "position", "score", F.col("splice_type").alias("pred_type"))
    annotation.write_bedgraph(rows, path, "scores", pred_type="donor")
    f = F.split("value", "\t")
    back = v.spark.read.text(path).filter("value not like 'track%'").select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("position"), f[3].cast("double").alias("score"))
    return rounded(back.filter("start = position - 1").select("chrom", "position", "score"), "score")


@query("""select line, cast(count(*) as bigint) as n from (select 'fixedStep chrom=chr' || gene_id || ' start=' || position || ' step=1' as line from (select *, lag(position) over (partition by gene_id order by position) as before from pos1) where before is null or position - before <> 1) group by line""")
def wig_blocks(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "wig")
    annotation.write_wig(v.pos1.select(F.concat(F.lit("chr"), F.col("gene_id").cast("string")).alias("chrom"), "position", "score"), path, "score")
    return v.spark.read.text(path).filter("value like 'fixedStep%'").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("select 'chr' || gene_id as chrom, position, cast(round(score * 100) as bigint) as score from pos1 where gene_id is not null")
def delimited_table(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "table")
    v.pos1.select(F.concat(F.lit("chr"), F.col("gene_id").cast("string")).alias("chrom"), "position", "score").write.option("header", True).option("sep", ";").csv(path)
    rows = annotation.read_delimited(v.spark, path)
    return rows.select("chrom", F.col("position").cast("long").alias("position"), F.round(F.col("score") * 100).cast("long").alias("score"))


@query("select id, cast(length(sequence) as bigint) as n from seqs where id % 7 = 3")
def chromosome_sequences(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "sequences")
    annotation.write_by_chromosome(v.seqs.withColumn("chrom", F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))), path)
    return annotation.read_sequences(v.spark, path, chrom="c3").select("id", F.length("sequence").cast("long").alias("n"))


@query("select gene_id, cast(count(*) as bigint) as n from positions group by gene_id")
def resumed_batches(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "batches")
    rows = v.positions.select("gene_id", "position", "score", (F.col("gene_id") % 4).cast("int").alias("gene_batch"))
    annotation.append_batches(rows.filter("gene_batch < 2"), path)  # a job that stopped half way
    annotation.append_batches(rows, path)
    return annotation.read_batches(v.spark, path, "gene_id long, position long, score double, gene_batch int").groupBy("gene_id").agg(F.count("*").alias("n"))


@query("select CHROM as chrom, POS as pos, ref, alt from variants where CHROM in ('3', '7') and POS between 20 and 120")
def bgzip_regions(v: Views) -> DataFrame:
    """Two regions of a sorted, block-compressed file of variants, through an index of its blocks."""
    path = scratch_dir(v.spark, "bgzip")
    rows = v.variants.select("CHROM", "POS", "ref", "alt", F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), "ref", "alt").alias("value"))
    bgzip.write_lines(rows.repartitionByRange(bgzip.files_for(rows, least=5), "CHROM", "POS").sortWithinPartitions("CHROM", "POS"), path)
    index = f"{path}-index"
    bgzip.block_index(v.spark, path, split=100_000).write.parquet(index)
    index_rows = v.spark.read.schema(bgzip.INDEX).parquet(index)
    regions = [bgzip.read_region(v.spark, path, index_rows, c, 20, 120) for c in ("3", "7")]
    f = F.split("line", "\t")
    return regions[0].unionByName(regions[1]).select("chrom", "pos", f[2].alias("ref"), f[3].alias("alt"))


@query("select cast(count(*) as bigint) as n, cast(sum(POS) as bigint) as total, cast(count(distinct CHROM) as bigint) as chroms from variants")
def bgzip_whole(v: Views) -> DataFrame:
    """Block-compressed files, each read by several tasks."""
    path = scratch_dir(v.spark, "bgzip")
    rows = v.variants.select(F.concat_ws("\t", "CHROM", F.col("POS").cast("string"), "ref", "alt").alias("value"))
    bgzip.write_lines(rows.repartition(bgzip.files_for(rows)), path)
    return bgzip.read_lines(v.spark, path, split=50_000).agg(F.count("*").alias("n"), F.sum("pos").alias("total"), F.countDistinct("chrom").alias("chroms"))


@query("select * from (values ('gene_id', 'bigint', 'numeric'), ('strand', 'string', 'categorical'), ('score', 'double', 'numeric')) t(name, dtype, type)")
def manifest(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "manifest")
    annotation.write_manifest(v.positions.select("gene_id", "strand", "score"), path)
    return annotation.read_manifest(v.spark, path)
