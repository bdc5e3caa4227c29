"""Explicit schemas of the annotation, prediction and variant tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _of(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


GTF = _of(seqname=_S, source=_S, feature=_S, start=_L, end=_L, score=_S, strand=_S, frame=_S, attribute=_S)
SPLICE_SITES = _of(
    chrom=_S, start=_L, end=_L, position=_L, strand=_S, site_type=_S, gene_id=_S, transcript_id=_S, gene_name=_S,
    gene_biotype=_S, transcript_biotype=_S, exon_id=_S, exon_number=_S, exon_rank=_I,
)
POSITIONS = _of(
    gene_id=_S, transcript_id=_S, position=_L, predicted_position=_L, true_position=_L, pred_type=_S, score=_D, strand=_S,
    donor_score=_D, acceptor_score=_D, neither_score=_D, splice_type=_S,
)
ERRORS = _of(gene_id=_S, transcript_id=_S, error_type=_S, position=_L, window_start=_L, window_end=_L, strand=_S, splice_type=_S)
DELTA_SCORES = _of(CHROM=_S, POS=_L, DS_AG=_D, DS_AL=_D, DS_DG=_D, DS_DL=_D, DP_AG=_I, DP_AL=_I, DP_DG=_I, DP_DL=_I)
SEQUENCES = _of(gene_id=_S, gene_name=_S, chrom=_S, strand=_S, start=_L, end=_L, sequence=_S)
#: Other names of columns, and the names that the engine uses.
SYNONYMS = {
    "seqname": "chrom", "chromosome": "chrom", "seqid": "chrom", "splice_site_type": "site_type", "type": "site_type",
    "gene": "gene_id", "tx_id": "transcript_id", "pos": "position",
}
