"""Files in and out."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from strandlake.functions import coords, sequences, variants
from strandlake.sources import annotation as an
from strandlake.sources import variants as va

GTF_TEXT = """#!genome-build test
1\thavana\tgene\t11\t40\t.\t+\t.\tgene_id "G1"; gene_name "one"; gene_biotype "protein_coding";
1\thavana\ttranscript\t11\t40\t.\t+\t.\tgene_id "G1"; transcript_id "T1.2"; gene_name "one"; gene_biotype "protein_coding"; tag "a"; tag "b";
1\thavana\texon\t11\t20\t.\t+\t.\tgene_id "G1"; transcript_id "T1.2"; exon_number "1"; exon_id "E1";
1\thavana\texon\t31\t40\t.\t+\t.\tgene_id "G1"; transcript_id "T1.2"; exon_number "2"; exon_id "E2";
chr2\thavana\ttranscript\t5\t9\t.\t-\t.\tgene_id "G2"; transcript_id "T2.1"; gene_name "two";
"""


def put(path, text):
    path.write_text(text)
    return str(path)


def whole(path):
    """The lines of a folder's parts in order of their names."""
    return [line for name in sorted(os.listdir(path)) if name.startswith("part-") for line in open(f"{path}/{name}").read().splitlines()]


def test_gtf(spark, tmp_path):
    gtf = an.read_gtf(spark, put(tmp_path / "a.gtf", GTF_TEXT)).cache()
    assert gtf.count() == 5
    assert [(r.gene_id, r.gene_length, r.chrom) for r in an.genes(gtf).collect()] == [("G1", 30, "1")]
    without = gtf.filter("feature != 'gene'")
    assert {(r.gene_id, r.start, r.end) for r in an.genes(without).collect()} == {("G1", 11, 40), ("G2", 5, 9)}
    assert an.lacks_genes(without) and not an.lacks_genes(gtf)
    assert {r.transcript_id for r in an.transcripts(gtf).collect()} == {"T1", "T2"}
    assert [(r.gene_name, r.exon_number, r.exon_length) for r in an.exons(gtf).orderBy("start").collect()] == [("G1", 1, 10), ("G1", 2, 10)]
    assert an.parts(gtf).count() == 2
    assert an.on_chromosomes(an.transcripts(gtf), ["2", "chr7"]).count() == 1
    an.save_gtf(gtf, f"{tmp_path}/gtf")
    assert "PartitionFilters: [isnotnull(feature" in spark.read.parquet(f"{tmp_path}/gtf").filter("feature = 'exon'")._jdf.queryExecution().toString()


def test_fasta_slices(spark, tmp_path):
    pieces = an.read_fasta(spark, put(tmp_path / "g.fa", ">1 first\nACGTACGT\nTTTTGGGG\nCC\n>chr2\nAAAACCCC\n"))
    spans = spark.createDataFrame([("x", "1", 1, 3, "+"), ("y", "1", 7, 18, "+"), ("z", "1", 7, 10, "-"), ("w", "chr2", 4, 5, "+")], "id string, chrom string, start long, end long, strand string")
    got = {r.id: r.sequence for r in an.slices(pieces, spans, ["id"], 8).collect()}
    assert got == {"x": "ACG", "y": "GTTTTTGGGGCC", "z": "AAAC", "w": "AC"}


def test_fasta_in_blocks(spark, tmp_path):
    """Records that end anywhere, cut by Spark into blocks of a few lines."""
    import random

    rng = random.Random(4)
    records = {f"r{k}": ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 12))] for k in range(40)}
    text = "".join(f">{n} some > text\n" + "".join(f"{x}\n" + "\n" * (rng.random() < 0.2) for x in lines) for n, lines in records.items())
    path = put(tmp_path / "many.fa", text)
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size in ("64b", "700b", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = an.read_fasta(spark, path).collect()
        got: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r.chrom, r.line)):
            got.setdefault(r.chrom, []).append((r.line, r.piece))
        assert got == {n: list(enumerate(x)) for n, x in records.items() if x}
    for k, v in sizes.items():
        spark.conf.set(k, v)


def test_single_tracks(spark, tmp_path):
    rows = spark.createDataFrame([(str(c), p, "+", "FP", "g", 0.5 + p / 100) for c in (1, 2, 3) for p in range(9, 1, -1)], "chrom string, position long, strand string, pred_type string, gene_id string, score double").repartition(4)
    an.write_bed(rows, f"{tmp_path}/b", "t", single=True)
    assert sum(x.startswith("part-") for x in os.listdir(f"{tmp_path}/b")) == 1
    lines = whole(f"{tmp_path}/b")
    assert lines[0] == 'track name="t" itemRgb="On"' and len(lines) == 25
    assert [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines[1:]] == [(str(c), p - 1) for c in (1, 2, 3) for p in range(2, 10)]
    an.write_bed(rows, f"{tmp_path}/m", "t")
    assert whole(f"{tmp_path}/m") == lines
    an.write_calls(rows, f"{tmp_path}/c", "t", "score", 0.55)
    assert len(whole(f"{tmp_path}/c")) == 1 + 3 * 5 and whole(f"{tmp_path}/c")[1].split("\t")[4] == "550"
    an.write_manifest(rows, f"{tmp_path}/j")
    assert [tuple(r) for r in an.read_manifest(spark, f"{tmp_path}/j").collect()][:2] == [("chrom", "string", "categorical"), ("position", "bigint", "numeric")]


def test_delimited(spark, tmp_path):
    rows = an.read_delimited(spark, put(tmp_path / "a.txt", "chrom;start;score\n1;5;0.5\nX;NA;1\n")).collect()
    assert [(r.chrom, r.start, r.score) for r in rows] == [("1", 5, 0.5), ("X", None, 1.0)]


def test_vcf(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t10\trs1\tA\tG,T\t50\tPASS\tAF=0.1;MC=splice_donor_variant\n2\t7\t.\tAC\tA\t.\t.\tCLNSIG=Benign\nbad line\n"
    rows = va.read_vcf(spark, put(tmp_path / "v.vcf", text), ["AF", "CLNSIG"]).orderBy("chrom", "alt").collect()
    assert [(r.chrom, r.pos, r.alt, r.INFO_AF, r.INFO_CLNSIG, r.variant_type, r.affects_splicing, r.splice_mechanism) for r in rows] == [("1", 10, "G", "0.1", None, "SNV", True, "direct_splice_site"), ("1", 10, "T", "0.1", None, "SNV", True, "direct_splice_site"), ("2", 7, "A", None, "Benign", "deletion", False, "none")]
    va.write_vcf(spark.createDataFrame([("1", 3, "a", "A", "C", None, "PASS", "X=1")], "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()][2:] == ["1\t3\ta\tA\tC\t.\tPASS\tX=1"]


def test_browser_tracks(spark, tmp_path):
    rows = spark.createDataFrame([("2", 5, "+", "FP", "g", 0.5), ("1", 9, "-", "FN", "h", 0.25), ("1", 10, "-", "TP", "h", 1.0)], "chrom string, position long, strand string, pred_type string, gene_id string, score double")
    an.write_bed(rows, f"{tmp_path}/bed", "t")
    assert whole(f"{tmp_path}/bed")[1:] == ["1\t8\t9\th\t0\t-\t0,0,255", "1\t9\t10\th\t0\t-\t0,0,0", "2\t4\t5\tg\t0\t+\t255,0,0"]
    an.write_bedgraph(rows, f"{tmp_path}/bg", "t", pred_type="FP")
    assert whole(f"{tmp_path}/bg")[1:] == ["2\t4\t5\t0.5"]
    an.write_wig(rows, f"{tmp_path}/wig", "score")
    assert whole(f"{tmp_path}/wig")[1:] == ["fixedStep chrom=1 start=9 step=1", "-0.602060", "0.000000", "fixedStep chrom=2 start=5 step=1", "-0.301030"]


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3) for k in range(9)], "x long, gene_batch int")
    assert an.append_batches(rows.filter("gene_batch = 0"), f"{tmp_path}/b").count() == 3
    an.append_batches(rows, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 9
    assert an.read_parts(spark, f"{tmp_path}/b", drop=["gene_batch"]).columns == ["x"]
    assert json.dumps(an.feature_manifest(rows))


def test_literals(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    lit = F.lit
    assert value(coords.to_relative(lit(41196312), lit(41196312), lit(41277500), lit("+"))) == 1
    assert value(coords.to_relative(lit(41277499), lit(41196312), lit(41277500), lit("-"))) == 2
    assert [value(coords.chrom_code(lit(c))) for c in ("1", "chr2", "X", "chrY", "MT", "GL0001")] == [1, 2, 23, 24, 25, 100]
    assert [value(coords.strand_sign(lit(s))) for s in ("1", "-1", "+", "-")] == ["+", "-", "+", "-"]
    assert value(F.struct(*variants.trim_alleles(lit("GAT"), lit("GT")))) == ("A", "-")
    assert value(sequences.kmers(lit("ACACGT"), 2)) == ["AC", "CA", "AC", "CG", "GT"]
    assert value(sequences.kmers(lit("A"), 2)) == [] and value(sequences.kmers(lit(None).cast("string"), 2)) in (None, [])
    assert value(sequences.motif_starts(lit("GTAGTT"), "GT")) == [0, 3]
    assert value(sequences.tumbling(lit("ACGTACG"), 3)) == ["ACG", "TAC"]
    assert value(sequences.window_slice(lit("ACGTACGT"), lit(1), 3)) == "ACGT"
    assert value(sequences.padded_window(lit("ACGT"), lit(0), 2)) == "NNACG"
    assert [value(sequences.valid_kmer(lit(k))) for k in ("ACN", "GGGGGG", "ACACAC", "ACGTAC", "GGG")] == [False, False, False, True, True]
    assert value(sequences.reverse_complement(lit("ACGN"))) == "NCGT"
    assert value(variants.gtf_attribute(lit('gene_id "G1"; gene_name "";'), "gene_name")) is None
    h = variants.hgvs(lit("NM_1.2:c.76_77del"))
    assert value(F.struct(h["base"], h["intronic"], h["change"])) == (76, 0, "del")
    assert value(F.struct(*va.split_location(lit("1-5-A-G")).values())) == ("1", 5, "A", "G")
    d = va.delta_annotation(lit("G|SYM|0.1|0.2|0.3|.|1|2|-3|4"))
    assert value(F.struct(d["symbol"], d["DS_DG"], d["DS_DL"], d["DP_DG"])) == ("SYM", 0.3, None, -3)


def test_batches_are_taken_up(spark, tmp_path):
    """A run that was killed after its data, or in the middle of them, is done again; complete batches are left alone."""
    schema, path = "k int, gene_batch int", f"{tmp_path}/b"
    rows = spark.createDataFrame([(k, k % 5 or None) for k in range(50)], schema)
    known = lambda: sorted((r.gene_batch or 0, r.k) for r in an.read_batches(spark, path, schema).collect())
    an.append_batches(rows.filter("gene_batch = 1"), path)
    first = known()
    assert first == [(1, k) for k in range(1, 50, 5)]
    rows.filter("gene_batch = 2 and k < 20").write.mode("append").partitionBy("gene_batch").parquet(path)  # killed before its entry
    rows.filter("gene_batch = 4").write.mode("append").partitionBy("gene_batch").parquet(path)
    assert known() == first
    an.append_batches(rows.filter("gene_batch <> 4 or gene_batch is null"), path)
    assert known() == sorted((k % 5, k) for k in range(50) if k % 5 != 4)
    an.append_batches(rows, path)
    an.append_batches(rows, path)
    assert known() == sorted((k % 5, k) for k in range(50))
    log = an.batch_log(spark, path, "int").collect()
    assert sorted((r.gene_batch or 0, r.n_rows) for r in log) == [(k, 10) for k in range(5)]
    rows.filter("gene_batch = 3").limit(1).write.mode("append").partitionBy("gene_batch").parquet(path)  # rows that no run has written
    with pytest.raises(Exception, match="does not have the rows"):
        known()
    an.append_batches(rows.limit(0), f"{tmp_path}/none")


def test_scratch_folders_go(spark):
    from strandlake.session import clean_scratch, scratch_dir

    spark.sparkContext.setCheckpointDir(f"file://{os.path.abspath('/tmp')}/strandlake-test-scratch")
    path = scratch_dir(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clean_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
