"""GTF, FASTA, BED, TSV, and sequence tables. Paths are read by Spark only, so any store that it knows will do."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coords import chrom_name
from ..functions.sequences import reverse_complement
from ..functions.variants import gtf_attribute
from ..schemas import GTF, SPLICE_SITES

# Attribute keys of GTF files, and the columns that they become.
ATTRIBUTES = {
    "gene_id": "gene_id", "gene_name": "gene_name", "gene_biotype": "gene_type", "transcript_id": "transcript_id",
    "transcript_name": "transcript_name", "transcript_biotype": "transcript_type", "exon_id": "exon_id", "exon_number": "exon_number",
}


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, text: Sequence[str] = ("chrom", "seqname", "chromosome")) -> DataFrame:
    """A table with a header; the separator is the most frequent of comma, tab, semicolon and bar in the first line.

    Without a schema all columns are read as text and then typed by name only: chromosomes stay text.
    """
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    sep = max(",\t;|", key=line.count)
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "NA")
    if schema:
        return reader.schema(schema).csv(path)
    rows = reader.csv(path)
    numbers = {c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(None)) for c in rows.columns if c in ("start", "end", "position", "score") and c not in text}
    return rows.withColumns({c: (v.cast("long") if c != "score" else v) for c, v in numbers.items()}) if numbers else rows


def read_splice_sites(spark: SparkSession, path: str) -> DataFrame:
    """The splice-site table, by its explicit schema."""
    if path.endswith(".parquet"):
        return spark.read.schema(SPLICE_SITES).parquet(path)
    return spark.read.schema(SPLICE_SITES).option("header", True).option("sep", "," if path.endswith(".csv") else "\t").csv(path)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a GTF file with its attributes as columns."""
    rows = spark.read.schema(GTF).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return with_attributes(rows)


def with_attributes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: gtf_attribute(F.col("attribute"), key) for key, name in ATTRIBUTES.items()})


def genes(gtf: DataFrame) -> DataFrame:
    """Gene rows; where the file has none, transcripts gathered to genes."""
    by_row = gtf.filter("feature = 'gene'").select("gene_id", "gene_name", "gene_type", F.col("seqname").alias("chrom"), "start", "end", "strand")
    first = F.min_by("strand", F.struct("start", "transcript_id"))
    gathered = gtf.filter("feature = 'transcript'").groupBy("gene_id").agg(F.min_by("gene_name", F.struct("start", "transcript_id")).alias("gene_name"), F.min_by("gene_type", F.struct("start", "transcript_id")).alias("gene_type"), F.min("seqname").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), first.alias("strand"))
    rows = gathered if lacks_genes(gtf) else by_row
    return rows.withColumn("gene_length", F.col("end") - F.col("start") + 1)


def lacks_genes(gtf: DataFrame) -> bool:
    """Whether a file has transcripts but no genes."""
    return gtf.filter("feature = 'gene'").isEmpty() and not gtf.filter("feature = 'transcript'").isEmpty()


def transcripts(gtf: DataFrame, ids: DataFrame | None = None, bare_ids: bool = True) -> DataFrame:
    """Transcript rows, of the given ids (column transcript_id) only; version suffixes are cut off."""
    name = F.split("transcript_id", r"\.")[0] if bare_ids else F.col("transcript_id")
    rows = gtf.filter("feature = 'transcript'").select(F.col("seqname").alias("chrom"), "start", "end", "strand", name.alias("transcript_id"), "transcript_name", "transcript_type", (F.col("end") - F.col("start") + 1).alias("transcript_length"), "gene_id")
    return rows if ids is None else rows.join(ids.select("transcript_id").distinct(), "transcript_id", "left_semi")


def exons(gtf: DataFrame) -> DataFrame:
    """Exon rows; a missing gene name is the gene's id."""
    return gtf.filter("feature = 'exon'").select(F.col("seqname").alias("chrom"), "start", "end", "strand", "transcript_id", "gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "exon_id", F.col("exon_number").try_cast("int").alias("exon_number"), (F.col("end") - F.col("start") + 1).alias("exon_length"))


def parts(gtf: DataFrame, features: Sequence[str] = ("exon", "CDS", "five_prime_utr", "three_prime_utr")) -> DataFrame:
    """Exon, CDS and UTR rows."""
    return gtf.filter(F.col("feature").isin(*features)).select("feature", F.col("seqname").alias("chrom"), "start", "end", "strand", "transcript_id", "gene_id")


def save_gtf(gtf: DataFrame, path: str) -> None:
    """The file as a table in folders by feature, so that a reader of exons reads nothing else."""
    gtf.write.mode("overwrite").partitionBy("feature").parquet(path)


def on_chromosomes(rows: DataFrame, names: Sequence[str], col: str = "chrom") -> DataFrame:
    """Rows of the named chromosomes, with or without chr on either side."""
    wanted = rows.sparkSession.createDataFrame([(n,) for n in names], "name string").select(chrom_name(F.col("name")).alias("name"))
    return rows.join(F.broadcast(wanted), chrom_name(F.col(col)) == F.col("name"), "left_semi")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, line, piece): the sequence lines of a FASTA file in order, from 0, each with the name of its record.

    The file is read by lines, in blocks as Spark cuts it. A line belongs to the last header before it, in its own block or
    in an earlier one; what goes over from block to block is a table with one row a block. Empty lines don't count.
    """
    lines = spark.read.text(path).select(F.trim(F.rtrim("value")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    lines = lines.filter("text != ''").withColumn("name", F.when(F.col("text").startswith(">"), F.regexp_extract("text", r"^>\s*(\S*)", 1)))
    w = Window.partitionBy("file", "block").orderBy("at")
    marked = lines.withColumns({"own": F.last("name", ignorenulls=True).over(w), "headers": F.count("name").over(w)})
    marked = marked.withColumn("inside", F.sum(F.col("name").isNull().cast("long")).over(Window.partitionBy("file", "block", "headers").orderBy("at")) - 1)
    # The largest mark of a block is its end: the last header, and the lines since.
    end = F.max_by(F.struct("own", F.when(F.col("name").isNull(), F.col("inside") + 1).otherwise(0).alias("tail")), "at")
    tails = marked.groupBy("file", "block").agg(end.alias("end")).select("file", "block", F.col("end.own").alias("last_name"), F.col("end.tail").alias("tail"))
    by_block = Window.partitionBy("file").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumns({"carried": F.last("last_name", ignorenulls=True).over(earlier), "run": F.count("last_name").over(by_block)})
    so_far = F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block"))
    tails = tails.withColumn("so_far", so_far).withColumn("skipped", F.coalesce(F.lag("so_far").over(by_block), F.lit(0))).select("file", "block", "carried", "skipped")
    rows = marked.filter("name is null").join(F.broadcast(tails), ["file", "block"])
    own = F.col("headers") > 0
    return rows.select(F.when(own, F.col("own")).otherwise(F.col("carried")).alias("chrom"), F.when(own, F.col("inside")).otherwise(F.col("inside") + F.col("skipped")).alias("line"), F.col("text").alias("piece"))


def slices(pieces: DataFrame, spans: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """spans (chrom, start, end: 1-based inclusive, strand) with their sequence, reversed on -; width is the letters of a full line.

    Spans meet just the lines that they cover, and the letters are put together span by span.
    """
    need = spans.withColumn("line", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))))
    cut = need.join(pieces, ["chrom", "line"])
    lo, hi = F.greatest(F.col("start") - 1 - F.col("line") * width, F.lit(0)), F.least(F.col("end") - F.col("line") * width, F.lit(width))
    part = F.struct("line", F.substring("piece", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    names = list(dict.fromkeys([*keys, "chrom", "start", "end", "strand"]))
    whole = cut.groupBy(*names).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["s"]), "").alias("sequence"))
    return whole.withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def read_sequences(spark: SparkSession, path: str, kind: str = "parquet", chrom: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """A sequence table; a chromosome is a pushed-down filter, targets (gene_id) a semi join."""
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if chrom is not None:
        rows = rows.filter(F.col("chrom") == chrom)
    return rows if targets is None else rows.join(targets.select("gene_id").distinct(), "gene_id", "left_semi")


def read_parts(spark: SparkSession, path: str, columns: Sequence[str] | None = None, drop: Sequence[str] = (), groups: DataFrame | None = None, key: str = "gene_id") -> DataFrame:
    """All Parquet files of a folder, with the union of their columns, less those to drop, and of the given groups only."""
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    rows = rows.select(*(c for c in (columns or rows.columns) if c in rows.columns and c not in drop))
    return rows if groups is None else rows.join(groups.select(key).distinct(), key, "left_semi")


def _line(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def write_bed(rows: DataFrame, path: str, track: str, name: str = "gene_id", single: bool = False) -> None:
    """A BED file with colours of error types: FP red, FN blue, others black; sorted by place, the track line first."""
    colour = F.when(F.col("pred_type") == "FP", "255,0,0").when(F.col("pred_type") == "FN", "0,0,255").otherwise("0,0,0")
    lines = rows.select("chrom", (F.col("position") - 1).alias("start"), F.col("position").alias("end"), _line("chrom", F.col("position") - 1, "position", name, F.lit(0), "strand", colour).alias("value"))
    write_track(lines, path, f'track name="{track}" itemRgb="On"', single)


def write_calls(rows: DataFrame, path: str, track: str, score: str, threshold: float = 0.5, name: str = "gene_id", single: bool = False) -> None:
    """A BED file of the positions whose score is at least the threshold, the score in thousandths as its fifth column."""
    called = rows.filter(F.col(score) >= threshold)
    lines = called.select("chrom", (F.col("position") - 1).alias("start"), F.col("position").alias("end"), _line("chrom", F.col("position") - 1, "position", name, F.round(F.col(score) * 1000).cast("int"), "strand").alias("value"))
    write_track(lines, path, f'track name="{track}" useScore=1', single)


def write_bedgraph(rows: DataFrame, path: str, track: str, score: str = "score", pred_type: str | None = None, single: bool = False) -> None:
    """A bedGraph of scores at single positions."""
    if pred_type is not None:
        rows = rows.filter(F.col("pred_type") == pred_type)
    lines = rows.select("chrom", (F.col("position") - 1).alias("start"), F.col("position").alias("end"), _line("chrom", F.col("position") - 1, "position", score).alias("value"))
    write_track(lines, path, f'track type=bedGraph name="{track}"', single)


def write_wig(rows: DataFrame, path: str, score: str, base: float = 10.0, eps: float = 1e-10, single: bool = False) -> None:
    """fixedStep blocks of the logarithm of a score; a block ends where the positions of a chromosome have a gap."""
    w = Window.partitionBy("chrom").orderBy("position")
    rows = rows.withColumn("fresh", F.coalesce((F.col("position") - F.lag("position").over(w) != 1).cast("int"), F.lit(1)))
    value = F.format_string("%.6f", F.log(base, F.col(score) + eps))
    head = F.concat(F.lit("fixedStep chrom="), F.col("chrom"), F.lit(" start="), F.col("position").cast("string"), F.lit(" step=1\n"))
    write_track(rows.select("chrom", F.col("position").alias("start"), F.col("position").alias("end"), F.concat(F.when(F.col("fresh") == 1, head).otherwise(""), value).alias("value")), path, "track type=wiggle_0", single)


def write_track(lines: DataFrame, path: str, header: str, single: bool = False) -> None:
    """(chrom, start, end, value) as text: the header, then the lines by place.

    The folder's parts, one after the other in order of their names, are the file. A browser wants one file: with `single`
    there is one part, which one task sorts and writes, so that is for tracks that people look at.
    """
    first = lines.sparkSession.createDataFrame([(header,)], "value string").select(F.lit(0).alias("rank"), F.lit("").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), "value")
    every = first.unionByName(lines.select(F.lit(1).alias("rank"), F.col("chrom").cast("string"), F.col("start").cast("long"), F.col("end").cast("long"), "value"))
    order = ["rank", "chrom", "start", "end", "value"]
    every = every.repartition(1).sortWithinPartitions(*order) if single else every.orderBy(*order)
    every.select("value").write.mode("overwrite").text(path)


def write_by_chromosome(rows: DataFrame, path: str, col: str = "chrom") -> None:
    rows.repartition(col).write.mode("overwrite").partitionBy(col).parquet(path)


COMMITS = "_commits"
_COMMIT = "n_rows long, run string, at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def batch_log(spark: SparkSession, path: str, kind: str, batch: str = "gene_batch") -> DataFrame:
    """(batch, n_rows, run, at) of the batches that are complete at path; kind is the batch column's type."""
    schema = f"{batch} {kind}, {_COMMIT}"
    if not _exists(spark, f"{path}/{COMMITS}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{COMMITS}")


def append_batches(rows: DataFrame, path: str, batch: str = "gene_batch") -> DataFrame:
    """Writes the batches that are not complete at path, in folders by batch, and returns those rows: a job that stopped goes on.

    A batch is complete when the log says so, which is written after the data, with the number of rows that were read back. A
    run that was killed leaves folders without an entry; these batches are written anew, over what is there, so nothing is
    lost and nothing comes twice. A null is a batch.
    """
    spark = rows.sparkSession
    kind = rows.schema[batch].dataType.simpleString()
    done = batch_log(spark, path, kind, batch).select(F.col(batch).alias("done_batch"))
    todo = rows.join(F.broadcast(done), F.col(batch).eqNullSafe(F.col("done_batch")), "left_anti")  # one row a batch
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(batch).parquet(path)
    if not _exists(spark, path):
        return todo
    stored = spark.read.option("pathGlobFilter", "*.parquet").schema(rows.schema).parquet(path).groupBy(batch).agg(F.count("*").alias("n_rows"))
    fresh = stored.join(todo.select(F.col(batch).alias("todo_batch")).distinct(), F.col(batch).eqNullSafe(F.col("todo_batch")), "left_semi")
    fresh.select(batch, "n_rows", F.lit(uuid.uuid4().hex).alias("run"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/{COMMITS}")
    return todo


def read_batches(spark: SparkSession, path: str, schema: str, batch: str = "gene_batch") -> DataFrame:
    """The rows of the batches that are complete at path; one whose number of rows is not that of the log is an error when it is read."""
    rows = spark.read.schema(schema).parquet(path)
    kind = rows.schema[batch].dataType.simpleString()
    log = batch_log(spark, path, kind, batch).groupBy(F.col(batch).alias("log_batch")).agg(F.max_by("n_rows", "at").alias("log_rows"))
    there = rows.groupBy(F.col(batch).alias("there_batch")).agg(F.count("*").alias("n"))
    known = log.join(there, F.col("log_batch").eqNullSafe(F.col("there_batch")), "left")
    wrong = F.raise_error(F.concat(F.lit("batch "), F.coalesce(F.col("log_batch").cast("string"), F.lit("null")), F.lit(" does not have the rows that were written")))
    known = known.select("log_batch", F.when(F.coalesce("n", F.lit(0)) == F.col("log_rows"), F.lit(True)).otherwise(wrong.cast("boolean")).alias("whole"))
    return rows.join(F.broadcast(known), F.col(batch).eqNullSafe(F.col("log_batch"))).filter("whole").drop("log_batch", "whole")


def write_manifest(rows: DataFrame, path: str) -> None:
    """feature_manifest as lines of JSON below path."""
    spark = rows.sparkSession
    spark.createDataFrame([tuple(x.values()) for x in feature_manifest(rows)], "name string, dtype string, type string").coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, dtype, type) of a table's columns, as write_manifest has them."""
    return spark.read.schema("name string, dtype string, type string").json(path)


def feature_manifest(rows: DataFrame) -> list[dict[str, str]]:
    """Names and types of the columns, for a JSON file beside a table."""
    return [{"name": c, "dtype": k, "type": "numeric" if k in ("double", "float", "int", "bigint") else "categorical"} for c, k in rows.dtypes]
