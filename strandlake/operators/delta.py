"""Delta scores: how much a variant raises or lowers the splice scores around it, for each gene that it lies in.

The reference window of a variant is cut from blocks of the genome by an equi-join on the blocks that it covers; reference and
alternative haplotype are strings made by column functions. A scorer, any function of batches of sequences, gives scores for
both; the alternative ones are brought to the places of the reference over an insertion or deletion, and the largest gain and
loss of both site types are taken with their places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from ..sources.annotation import chrom_name, slices

#: Letters of the blocks that windows are cut from.
BLOCK = 16_384
#: Sequences that a scorer gets at once.
BATCH = 64

Scorer = Callable[[Sequence[str]], Sequence[np.ndarray]]
KINDS = ("AG", "AL", "DG", "DL")
RESULT = ", ".join([*(f"DS_{k} double" for k in KINDS), *(f"DP_{k} long" for k in KINDS)])


def blocks(pieces: DataFrame, width: int, letters: int = BLOCK) -> tuple[DataFrame, int]:
    """(blocks, letters of a full one): the lines (chrom, line, piece) of `width` letters, put together to larger ones."""
    per = max(1, letters // width)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("chrom", F.floor(F.col("line") / per).alias("block")).agg(F.array_join(lines, "").alias("piece")).withColumnRenamed("block", "line"), per * width


def gene_spans(genes: DataFrame, exons: DataFrame, by: str = "gene_id") -> DataFrame:
    """(gene, chrom, strand, start, end, edges): genes with the places where an exon starts or ends, each once and in order."""
    edges = exons.select(by, F.explode(F.array("start", "end")).alias("edge")).groupBy(by).agg(F.sort_array(F.collect_set("edge")).alias("edges"))
    return genes.select(by, "chrom", "strand", "start", "end").join(edges, by, "left").withColumnRenamed(by, "gene")


def in_genes(variants: DataFrame, spans: DataFrame, bin_width: int = 10_000) -> DataFrame:
    """Variants with each gene that has their position; names of chromosomes with and without chr are the same."""
    binned = spans.withColumn("gene_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width)))).withColumn("gene_chrom", chrom_name(F.col("chrom"))).drop("chrom")
    meet = (chrom_name(F.col("chrom")) == F.col("gene_chrom")) & (F.floor(F.col("pos") / bin_width) == F.col("gene_bin")) & F.col("pos").between(F.col("start"), F.col("end"))
    return variants.join(binned, meet).drop("gene_bin", "gene_chrom")


def nearest_edge(edges: Column, pos: Column) -> Column:
    """How far the nearest place is from pos, with its sign; of two the lower one. Null without places."""
    near = F.array_min(F.transform(edges, lambda e: F.struct(F.abs(e - pos).alias("off"), (e - pos).alias("by"))))
    return near["by"]


def haplotypes(variants: DataFrame, pieces: DataFrame, width: int, reach: int, flank: int) -> DataFrame:
    """variants (chrom, pos, ref, alt, start, end: of the gene) with x_ref and x_alt: the window with N outside the gene, and the same with the alternative.

    A variant goes whose reference allele is not what the genome has, whose window leaves the chromosome, whose reference
    allele is longer than twice the reach, or whose alternative is a symbol.
    """
    half = flank + reach
    named = variants.withColumn("chrom", chrom_name(F.col("chrom")))
    good = named.filter((F.length("ref") <= 2 * reach) & ~F.col("alt").rlike(r"[.*<>\-]"))
    spans = good.select("chrom", "pos").distinct().select("chrom", "pos", (F.col("pos") - half).alias("start"), (F.col("pos") + half).alias("end"), F.lit("+").alias("strand"))
    inside = spans.filter("start >= 1")
    cut = slices(pieces.withColumn("chrom", chrom_name(F.col("chrom"))), inside, ["chrom", "pos"], width)
    cut = cut.filter(F.length("sequence") == 2 * half + 1).select("chrom", "pos", "sequence")
    out = good.join(cut, ["chrom", "pos"]).filter(F.upper(F.substring("sequence", half + 1, F.length("ref"))) == F.col("ref"))
    left, right = (F.greatest(x, F.lit(0)).cast("int") for x in (half + F.col("start") - F.col("pos"), half - (F.col("end") - F.col("pos"))))
    own = F.concat(F.repeat(F.lit("N"), left), F.substring(F.col("sequence"), left + 1, 2 * half + 1 - left - right), F.repeat(F.lit("N"), right))
    out = out.withColumn("x_ref", own)
    alternative = F.concat(F.substring("x_ref", 1, half), F.col("alt"), F.substring(F.col("x_ref"), half + F.length("ref") + 1, F.lit(2 * half + 1)))
    return out.withColumn("x_alt", alternative).drop("sequence")


def aligned(scores: np.ndarray, reach: int, n_ref: int, n_alt: int) -> np.ndarray:
    """Scores of the alternative at the places of the reference: zero where letters are deleted, the largest over inserted ones."""
    if n_ref > 1 and n_alt == 1:
        return np.concatenate((scores[: reach + 1], np.zeros((n_ref - 1, scores.shape[1])), scores[reach + 1 :]))
    if n_ref == 1 and n_alt > 1:
        return np.concatenate((scores[:reach], scores[reach : reach + n_alt].max(axis=0)[None], scores[reach + n_alt :]))
    return scores


def deltas(ref: np.ndarray, alt: np.ndarray, reach: int, edge: int | None, mask: bool) -> tuple[list[float], list[int]]:
    """Scores and places, by KINDS, from (neither, acceptor, donor) of both alleles at the same places.

    Masked are gains where an exon ends already, and losses elsewhere.
    """
    scores, places = [], []
    for site in (1, 2):
        for sign in (1, -1):
            change = sign * (alt[:, site] - ref[:, site])
            k = int(change.argmax())
            hidden = mask and ((k - reach == edge) == (sign > 0))
            scores.append(0.0 if hidden else float(change[k]))
            places.append(k - reach)
    return scores, places


def delta_scores(variants: DataFrame, spans: DataFrame, pieces: DataFrame, width: int, scorer: Scorer, reach: int = 50, flank: int = 5_000, mask: bool = False, precision: int = 2) -> DataFrame:
    """A row for each variant (chrom, pos, ref, alt) and gene of `spans` (see gene_spans) that it lies in, with RESULT.

    pieces are the genome's lines of `width` letters. scorer gets sequences in the gene's direction and gives for each one an
    array (places, 3) of its places but `flank` on either side. Where reference and alternative both have several letters
    the scores are null; other columns of variants stay.
    """
    big, letters = blocks(pieces, width)
    genes = in_genes(variants, spans).withColumn("edge", nearest_edge(F.col("edges"), F.col("pos"))).drop("edges")
    rows = haplotypes(genes, big, letters, reach, flank)
    several = (F.length("ref") > 1) & (F.length("alt") > 1)
    for x in ("x_ref", "x_alt"):
        rows = rows.withColumn(x, F.when(several, F.lit(None)).when(F.col("strand") == "-", reverse_complement(F.col(x))).otherwise(F.col(x)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = part.select(["x_ref", "x_alt", "strand", "ref", "alt", "edge"]).to_pylist()
                known = [r for r in rows if r["x_ref"] is not None]
                found = iter(scorer([r[x] for r in known for x in ("x_ref", "x_alt")]) if known else ())
                out: list[list] = []
                for r in rows:
                    if r["x_ref"] is None:
                        out.append([None] * 8)
                        continue
                    a, b = (np.asarray(y)[::-1] if r["strand"] == "-" else np.asarray(y) for y in (next(found), next(found)))
                    scores, places = deltas(a, aligned(b, reach, len(r["ref"]), len(r["alt"])), reach, r["edge"], mask)
                    out.append([*(round(s, precision) + 0.0 for s in scores), *places])
                kinds = [pa.float64()] * 4 + [pa.int64()] * 4
                more = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                kept = part.drop_columns(["x_ref", "x_alt", "edge"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*kept.schema.names, *(x.split()[0] for x in RESULT.split(", "))])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("x_ref", "x_alt", "edge")]
    return rows.mapInArrow(score, ", ".join([*kept, RESULT]))


def motif_scorer(flank: int) -> Scorer:
    """A scorer without a model: hundredths by three letters (A, C, G, T and others: 0 to 3 and 0), for an acceptor around a place, for a donor from it on."""
    code = np.zeros(256, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = [0, 1, 2, 3]

    def score(sequences: Sequence[str]) -> list[np.ndarray]:
        out = []
        for s in sequences:
            x = code[np.frombuffer(s.encode(), np.uint8)]
            n = len(x) - 2 * flank
            at = flank + np.arange(n)
            acceptor = (16 * x[at - 1] + 4 * x[at] + x[at + 1]) / 100
            donor = (x[at] + 4 * x[at + 1] + 16 * x[at + 2]) / 100
            out.append(np.stack((1 - acceptor - donor, acceptor, donor), axis=1))
        return out

    return score
