"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio of trusted text against the corpus.

Words and word pairs are hashed to buckets. Their number grows with the square root of the corpus's text, as that of its
different n-grams grows more slowly than the text, and as every task has counts of most buckets. Two multinomials are counted: over documents that labels trust (a bounded sample of
them), and over the whole corpus. A document's score is the mean over its n-grams of log2(trusted / corpus), in whole steps
of 2^-20, so that sums do not depend on their order; below `THRESHOLD` it is rejected.

The ratios are broadcast, SLICE buckets at a time: with more of them the documents are read once for each slice, and what
its n-grams add to a text's sum is kept by a hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, byte_map, chunks, every, lean, mix64, park, shingle_hashes, span_hashes, table, text_buffer, unused, word_spans

#: The least number of buckets, which is that of a corpus of so many bytes; four times the text has twice the buckets.
LEAST_BUCKETS, LEAST_BYTES = 1 << 16, 64 << 20
#: Most ratios that a task holds at once (4 bytes each).
SLICE = 1 << 23
#: Most buckets that a task counts in an array; with more it sends on the counts of each chunk of text.
DENSE = 1 << 20
#: Trusted documents that the target is counted over, in expectation; more labels are thinned by a hash of the id.
TRUSTED = 20_000
#: Bits an n-gram, below which a document is rejected.
THRESHOLD = -0.3
#: Occurrences added to a bucket on both sides, so that n-grams too rare to tell count for little.
PRIOR = 4.0
SCALE = 1 << 20
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: First bytes of code points outside white space.
_HEAD = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def n_buckets(docs: DataFrame, text_col: str = "text") -> int:
    """The number of buckets for a corpus, by its bytes."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_BUCKETS, round(LEAST_BUCKETS * math.sqrt(total / LEAST_BYTES)))


def _ngrams(words: np.ndarray, row_of: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of the word pairs, and each pair's row, from the words' hashes and rows."""

    def bucket(hashes: np.ndarray) -> np.ndarray:
        """A share of the number of buckets, by the upper half of a hash."""
        return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)

    if len(words) < 2:
        return bucket(words), np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = row_of[1:] == row_of[:-1]
    return bucket(words), bucket(shingle_hashes(words, 2)[same]), row_of[:-1][same]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which keys occur more than once in their row."""
    with np.errstate(over="ignore"):
        keys = mix64(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


@dataclass(frozen=True)
class Ratios:
    """Ratios of some of `buckets` buckets, from bucket `first` on; others count for nothing."""

    buckets: int
    first: int
    steps: np.ndarray

    def __call__(self, at: np.ndarray) -> np.ndarray:
        if len(self.steps) == self.buckets:
            return self.steps.take(at).astype(np.int64)
        inside = (at >= self.first) & (at < self.first + len(self.steps))
        return np.where(inside, self.steps.take(at - self.first, mode="clip"), 0).astype(np.int64)


def base_counts(texts: pa.Array, ratio: Ratios | None = None) -> dict[str, np.ndarray]:
    """The counts in FIELDS of every text, and with the buckets' ratios also the sum `llr` over `n_grams`."""
    raw_all, offsets_all = text_buffer(texts)
    parts: dict[str, list[np.ndarray]] = {}
    for lo, hi in chunks(offsets_all):
        base = offsets_all[lo]
        raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
        n = hi - lo
        starts, ends, before = word_spans(raw, offsets)
        row_of = np.repeat(np.arange(n), np.diff(before))

        def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])  # noqa: B023

        got = {"n_words": np.diff(before), "word_chars": per_row(byte_map(raw, _HEAD), offsets), "n_symbols": per_row(byte_map(raw, _SYMBOL), offsets)}
        words = span_hashes(raw, starts, ends)
        threes = shingle_hashes(words, 3)
        inside = row_of[2:] == row_of[:-2] if len(words) > 2 else np.zeros(0, bool)
        twice = np.zeros(len(threes), bool)
        twice[inside] = _repeats(threes[inside], row_of[: len(threes)][inside])
        covered = np.zeros(len(words) + 1, bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        got["n_repeat_words"] = per_row(covered[: len(words)], before)
        # Lines: cut at \n only, so spans may hold other white space; those without a word don't count.
        l_starts, l_ends, l_before = word_spans(raw, offsets, _NEWLINE)
        l_row = np.repeat(np.arange(n), np.diff(l_before))
        has_word = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
        l_keys, l_row = span_hashes(raw, l_starts[has_word], l_ends[has_word]), l_row[has_word]
        with np.errstate(over="ignore"):
            keys = mix64(l_keys + l_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        again = order[1:][keys[order][1:] == keys[order][:-1]]
        got["n_dup_lines"] = np.bincount(l_row[again], minlength=n)
        if ratio is not None:
            ones, pairs, pair_rows = _ngrams(words, row_of, ratio.buckets)
            pair_before = np.searchsorted(pair_rows, np.arange(n + 1))
            got["llr"] = per_row(ratio(ones), before) + per_row(ratio(pairs), pair_before)
            got["n_grams"] = got["n_words"] + np.diff(pair_before)
        for k, v in got.items():
            parts.setdefault(k, []).append(v.astype(np.int64))
    names = [*FIELDS, *(["llr", "n_grams"] if ratio is not None else [])]
    return {k: np.concatenate(parts[k]) if k in parts else np.zeros(0, np.int64) for k in names}


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids that labels call good and not toxic, thinned by a hash of the id to about `most`."""
    good = labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("trusted_id")).filter("trusted_id is not null").distinct()
    share = min(1.0, most / max(1, good.count()))
    return good.filter(F.pmod(F.xxhash64(F.lit(11), "trusted_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def ngram_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRUSTED, buckets: int | None = None) -> Iterator[Ratios]:
    """log2(trusted / corpus) of each bucket in steps of 1/SCALE, SLICE buckets at a time; every document of docs counts for the corpus.

    PRIOR occurrences are added on both sides, the corpus's counts being scaled to the size of the trusted text. Without
    trusted documents all ratios are zero.
    """
    n = buckets or n_buckets(docs, text_col)
    trusted = F.broadcast(trusted_ids(labels, most))  # about `most` ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(trusted, F.col("id") == F.col("trusted_id"), "left")
    rows = rows.select("text", F.col("trusted_id").isNotNull().alias("trusted"))

    def batch(corpus: np.ndarray, good: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(corpus), pa.array(good)], ["bucket", "corpus", "trusted"])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n), np.int64) if n <= DENSE else None
        for b in batches:
            raw_all, offsets_all = text_buffer(b.column(0))
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(offsets_all):
                base = offsets_all[lo]
                raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
                starts, ends, before = word_spans(raw, offsets)
                row_of = np.repeat(np.arange(hi - lo), np.diff(before))
                ones, twos, two_rows = _ngrams(span_hashes(raw, starts, ends), row_of, n)
                t = good[lo:hi]
                if counts is None:
                    at, back = np.unique(np.concatenate((ones, twos)), return_inverse=True)
                    weights = np.concatenate((t[row_of], t[two_rows]))
                    yield batch(np.bincount(back, minlength=len(at)), np.bincount(back, weights, len(at)).astype(np.int64), at)
                    continue
                counts[0] += np.bincount(ones, minlength=n) + np.bincount(twos, minlength=n)
                if t.any():
                    counts[1] += np.bincount(ones[t[row_of]], minlength=n) + np.bincount(twos[t[two_rows]], minlength=n)
        if counts is not None:
            k = np.flatnonzero(counts[0])
            yield batch(counts[0, k], counts[1, k], k)

    summed = park(rows.mapInArrow(count, "bucket long, corpus long, trusted long").groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted")))
    all_, good = summed.agg(F.sum("corpus"), F.sum("trusted")).first()
    for first in range(0, n, SLICE):
        steps = np.zeros(min(n, SLICE), np.int32)
        if good:
            got = summed.filter(F.col("bucket").between(first, first + SLICE - 1)).toArrow()  # SLICE rows at most
            expected = got.column("corpus").to_numpy() * (good / all_)  # what trusted text would have if it were like the corpus
            steps[got.column("bucket").to_numpy() - first] = np.rint(np.log2((got.column("trusted").to_numpy() + PRIOR) / (expected + PRIOR)) * SCALE)
            # Buckets without an occurrence have ratio 0, and no text asks for them.
        yield Ratios(n, first, steps)


def _sums(text: Column, shared: Broadcast) -> Column:
    """What the ratios of a slice add to the sum of each text."""

    @F.arrow_udf("long")
    @lean
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(base_counts(batch, shared.value)["llr"])

    return of(text)


def _judge(text: Column, shared: Broadcast, further: Column, threshold: float) -> Column:
    """The verdict on each text, `further` being what other slices add to its sum."""
    counts = ",".join(f"{k}:long" for k in FIELDS)

    @F.arrow_udf(f"struct<{counts},llr:double,base_failed:boolean,kept:boolean>")
    @lean
    def of(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, more in texts:
            got = base_counts(batch, shared.value)
            llr = got["llr"] + more.to_numpy()
            failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
            # Compared in whole steps: sum >= threshold * n.
            good = llr >= int(round(threshold * SCALE)) * got["n_grams"]
            yield pa.StructArray.from_arrays([*(pa.array(got[k]) for k in FIELDS), pa.array(llr / np.maximum(got["n_grams"], 1) / SCALE), pa.array(failed), pa.array(good & ~failed)], [*FIELDS, "llr", "base_failed", "kept"])

    return of(text, further)


def with_verdict(docs: DataFrame, labels: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int | None = None) -> DataFrame:
    """docs with a column `name`: a struct of FIELDS, llr (bits an n-gram), base_failed and kept.

    A null or empty text has no words, and fails. Rows are judged one by one by their text, so repeated rows and ids make no
    difference; a null id is never trusted. An empty table gives an empty one; without labels the base rules alone decide.
    """
    sc = docs.sparkSession.sparkContext
    text = F.col(text_col).cast("string")
    ratios = ngram_ratios(docs, labels, id_col, text_col, buckets=buckets)
    first, found = sc.broadcast(next(ratios)), []
    for ratio in ratios:
        shared = sc.broadcast(ratio)
        found.append(park(docs.select(F.xxhash64(text).alias("text_hash"), _sums(text, shared).alias("llr")).dropDuplicates(["text_hash"])))
        shared.destroy()
    if not found:
        return docs.withColumn(name, _judge(text, first, F.lit(0).cast("long"), threshold))
    hash_, more = unused([*docs.columns, name], "text_hash", "more")
    sums = reduce(DataFrame.unionByName, found).groupBy("text_hash").agg(F.sum("llr").alias(more)).withColumnRenamed("text_hash", hash_)
    rows = docs.withColumn(hash_, F.xxhash64(text)).join(park(sums), hash_)
    return rows.withColumn(name, _judge(text, first, F.col(more), threshold)).select(*every(docs, name), name)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass the base rules and the ratio, with the columns of docs, whatever their names; see `with_verdict`."""
    (name,) = unused(docs.columns, "quality_verdict")
    return with_verdict(docs, labels, name, id_col, text_col, threshold).filter(F.col(name)["kept"]).select(*every(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_verdict(docs, table(spark, sf_dir, "labels"), "v").select("doc_id", "v.*")


QUERIES = {"op10_quality_llr": query}
