"""Positions and strands. Genomic positions are 1-based; `0` in a name marks a 0-based offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset0(position: Column, start: Column, end: Column, strand: Column) -> Column:
    """0-based offset from the gene's 5' end."""
    return F.when(strand == "+", position - start).otherwise(end - position)


def to_relative(position: Column, start: Column, end: Column, strand: Column) -> Column:
    """1-based position from the gene's 5' end."""
    return offset0(position, start, end, strand) + 1


def to_absolute(relative: Column, start: Column, end: Column, strand: Column) -> Column:
    """The genomic position of a 1-based relative one."""
    return F.when(strand == "+", start + relative - 1).otherwise(end - relative + 1)


def window_index(window_start: Column, window_end: Column, position: Column, strand: Column) -> Column:
    """Index of a position in its half-open window, read along the strand."""
    return F.when(strand == "+", position - window_start).otherwise(window_end - 1 - position)


def boundary_status(gene_start: Column, gene_end: Column, tx_start: Column, tx_end: Column) -> Column:
    """within, no_overlap or partial: how a transcript lies to its gene."""
    inside = (tx_start >= gene_start) & (tx_end <= gene_end)
    apart = (tx_end < gene_start) | (tx_start > gene_end)
    return F.when(inside, "within").when(apart, "no_overlap").otherwise("partial")


def strand_sign(strand: Column) -> Column:
    """+ or - for 1, -1, + and -; other values stay."""
    text = strand.cast("string")
    return F.when(text.isin("1", "+"), "+").when(text.isin("-1", "-"), "-").otherwise(text)


def chrom_name(chrom: Column) -> Column:
    """Without the prefix chr, X, Y and MT in upper case."""
    bare = F.regexp_replace(chrom, "(?i)^chr", "")
    upper = F.upper(bare)
    return F.when(upper.isin("X", "Y", "MT"), upper).when(upper == "M", "MT").otherwise(bare)


def chrom_code(chrom: Column, unknown: int = 100) -> Column:
    """1 to 22, X 23, Y 24, MT 25; others from `unknown` on are told apart by the caller."""
    name = chrom_name(chrom)
    number = F.when(name.rlike("^[0-9]+$"), name.cast("int"))
    return F.when(name == "X", 23).when(name == "Y", 24).when(name == "MT", 25).when(number.between(1, 22), number).otherwise(unknown)


def probability_ok(*scores: Column, tolerance: float = 0.01) -> Column:
    """Whether scores add up to 1."""
    return F.abs(sum(scores[1:], scores[0]) - 1) <= tolerance


def position_kind(position: Column, start: Column, end: Column) -> Column:
    """Aggregate: absolute, relative or unclear, by where at least nine of ten positions of a group lie."""
    absolute, relative = F.avg(position.between(start, end).cast("double")), F.avg(position.between(1, end - start + 1).cast("double"))
    return F.when((absolute >= 0.9) & (absolute >= relative), "absolute").when(relative >= 0.9, "relative").otherwise("unclear")
