"""Nucleotide strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(seq: Column) -> Column:
    """The letters as an array; substrings of a long string would be searched for from its start each time."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def _by_phase(seq: Column, k: int) -> list[Column]:
    """The k-mers that start at places 0, k, 2k, ...; at 1, k + 1, ...; and so on: a pass of a pattern for each phase."""
    return [F.regexp_extract_all(F.substring(seq, o + 1, 2**31 - 1), F.lit(f"(?s).{{{k}}}"), F.lit(0)) for o in range(k)]


def kmer_bag(seq: Column, k: int) -> Column:
    """All k-mers, in no order; none for a null or shorter string."""
    return F.coalesce(F.flatten(F.array(*_by_phase(seq, k))), F.array().cast("array<string>"))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none for a null or shorter string."""
    if k == 1:
        return kmer_bag(seq, 1)
    phases = F.arrays_zip(*_by_phase(seq, k))
    every = F.array_compact(F.flatten(F.transform(phases, lambda x: F.array(*(x[str(o)] for o in range(k))))))
    return F.coalesce(every, F.array().cast("array<string>"))


def valid_kmer(kmer: Column) -> Column:
    """Without N, and from six letters on neither one of G or C throughout nor a repeated pair."""
    low = kmer.rlike("^(G+|C+)$") | kmer.rlike("^(..)\\1+.?$")
    return ~kmer.contains("N") & ~((F.length(kmer) >= 6) & low)


def gc_content(seq: Column) -> Column:
    """Share of G and C, in either case; 0 for an empty string."""
    n = F.length(seq)
    return F.when(n > 0, F.regexp_count(F.upper(seq), F.lit("[GC]")) / n).otherwise(0.0)


def entropy(seq: Column, alphabet: str = "ACGT") -> Column:
    """Shannon entropy in bits of the letters of an alphabet, by case."""
    n = F.length(seq)

    def part(c: str) -> Column:
        p = F.regexp_count(seq, F.lit(c)) / F.nullif(n, F.lit(0))
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    parts = [part(c) for c in alphabet]
    return sum(parts[1:], parts[0])


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def motif_starts(seq: Column, motif: str) -> Column:
    """0-based starts of a motif that cannot overlap itself."""
    return F.filter(F.transform(kmers(seq, len(motif)), lambda x, i: F.when(x == motif, i)), lambda i: i.isNotNull())


def pattern_matches(seq: Column | str, pattern: str) -> Column:
    """(start, match) of a regular expression's matches from left to right, none overlapping an earlier one."""
    found = re.compile(pattern)

    @F.arrow_udf("array<struct<start:int,match:string>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("match", pa.string())]))
        for batch in batches:
            yield pa.array([[{"start": m.start(), "match": m.group()} for m in found.finditer(x or "")] for x in batch.to_pylist()], kind)

    return of(seq)


def composition_entropy(seq: Column) -> Column:
    """Shannon entropy in bits of all letters of a string, whatever its alphabet; 0 for an empty string."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[float | None] = []
            for x in batch.to_pylist():
                if x is None:
                    out.append(None)
                    continue
                raw = np.frombuffer(x.encode(), np.uint8) if x.isascii() else np.unique(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1]
                n = np.bincount(raw)
                p = n[n > 0] / max(1, len(raw))
                out.append(float(-(p * np.log2(p)).sum()) + 0.0)
            yield pa.array(out, pa.float64())

    return of(seq)


def window_slice(seq: Column, position: Column, radius: int) -> Column:
    """seq[max(position - radius, 0) : min(position + radius, length)], by 0-based positions."""
    start = F.greatest(position - radius, F.lit(0))
    end = F.least(position + radius, F.length(seq))
    return F.when(end > start, F.substring(seq, (start + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def padded_window(seq: Column, position: Column, radius: int) -> Column:
    """2 * radius + 1 letters around a 0-based position, N beyond the string."""
    left, right = F.greatest(radius - position, F.lit(0)), F.greatest(position + radius + 1 - F.length(seq), F.lit(0))
    inner = F.substring(seq, (F.greatest(position - radius, F.lit(0)) + 1).cast("int"), (2 * radius + 1 - left - right).cast("int"))
    return F.concat(F.repeat(F.lit("N"), left.cast("int")), inner, F.repeat(F.lit("N"), right.cast("int")))


def tumbling(seq: Column, size: int) -> Column:
    """Consecutive windows of `size` letters; a shorter rest is left out."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{{size}}}"), F.lit(0))


def one_hot(seq: Column, alphabet: str = "ACGT") -> Column:
    """For each letter one number for each letter of the alphabet; all zero for others."""
    return F.transform(letters(F.upper(seq)), lambda c: F.array(*(F.when(c == a, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float") for a in alphabet)))


def context_blocks(seq: Column, block: int, context: int) -> Column:
    """Consecutive blocks of `block` letters with context / 2 letters on either side, N beyond the string: (index, piece)."""
    n = F.ceil(F.length(seq) / block)
    padded = F.concat(F.repeat(F.lit("N"), context // 2), seq, F.repeat(F.lit("N"), (n * block - F.length(seq)).cast("int") + context // 2))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda k: F.struct(k.alias("index"), F.substring(padded, (k * block + 1).cast("int"), F.lit(block + context)).alias("piece")))
    return F.when(n >= 1, every).otherwise(F.array().cast("array<struct<index:bigint,piece:string>>"))
