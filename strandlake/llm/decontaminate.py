"""Benchmark decontamination: item-sized windows of each document, compared with the items by SimHash and then exactly.

A window of as many words as an item has is a copy of it if the weighted Jaccard similarity of their five-word shingles
(repeats count) is 0.8 or more. Each item has probes, its rarest shingles: so many that a text without any of them lacks
too much of the item. An item is taken up where one of its probes stands, and then the windows that hold enough of its
shingles by number; phrases that many items share are no probes. The SimHash fingerprints of these windows are looked up in
a multi-index: the 64 bits are cut into BLOCKS blocks, and each block's values within RADIUS // BLOCKS bits list their
items, which finds every item within RADIUS bits. The candidates are then compared exactly, in one pass over the windows of
an item. A pair of similarity 0.8 differs in 10 bits on average, with a deviation below 3, so by calculation the radius
leaves out one in a million.

A document of fewer words than an item is one window itself: both shingle counts enter the similarity, and as there is but
one such window, it is compared with every item that shares a probe and has not too many more, whatever its fingerprint.

A benchmark of more than PASS_BYTES is taken in passes, one after the other: each reads the documents anew with its own
part of the index, and keeps the hits alone. An index is broadcast, and is gone when its pass is over.

Words are runs of letters and digits (and of bytes beyond ASCII), in lower case, so that punctuation does not hide a copy.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, every, if_small, lean, mix64, park, shingle_hashes, span_hashes, table, text_buffer, unused, word_spans

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
#: Bytes of items that one pass sends to the tasks; a larger benchmark is taken in several passes.
PASS_BYTES = 16 << 20

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
HITS = "array<struct<item_id:long,start:int,words:int,bits:int,similarity:double>>"


class ItemIndex:
    """Items of the benchmark by size, with their shingles and fingerprint blocks."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.ids: list[int] = []
        self.size: list[int] = []
        self.shingles: list[np.ndarray] = []
        raw, offsets = text_buffer(pc.utf8_lower(pa.array([t or "" for _, t in items], pa.large_string())))
        starts, ends, before = word_spans(raw, offsets, _GAP)
        words = span_hashes(raw, starts, ends)
        for (item, _), lo, hi in zip(items, before[:-1], before[1:], strict=True):
            if hi > lo:
                self.ids.append(item)
                self.size.append(int(hi - lo))
                self.shingles.append(shingle_hashes(words[lo:hi], min(WIDTH, int(hi - lo))))
        holders = Counter(h for own in self.shingles for h in np.unique(own).tolist())
        #: By shingle width: sorted probes, the items that each stands for, and a bit for each low end of a probe.
        self.places: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        for width in {min(WIDTH, n) for n in self.size}:
            at: dict[int, list[int]] = defaultdict(list)
            for i, own in enumerate(self.shingles):
                if min(WIDTH, self.size[i]) == width:
                    for h in self._probes(own, holders):
                        at[h].append(i)
            keys = np.array(sorted(at), dtype=np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.places[width] = (keys, [at[k] for k in keys.tolist()], seen)
        self.prints = np.array([simhash_windows(s, np.array([0]), len(s))[0] for s in self.shingles], dtype=np.uint64)
        bits, most = 64 // BLOCKS, radius // BLOCKS
        near = [sum(1 << b for b in flip) for r in range(most + 1) for flip in combinations(range(bits), r)]
        #: (size, block, block's value) -> items of that size within most bits in that block.
        self.blocks: dict[tuple[int, int, int], set[int]] = defaultdict(set)
        for i, p in enumerate(self.prints.tolist()):
            for b in range(BLOCKS):
                v = (p >> (b * bits)) & ((1 << bits) - 1)
                for flip in near:
                    self.blocks[self.size[i], b, v ^ flip].add(i)

    def _probes(self, shingles: np.ndarray, holders: Counter) -> list[int]:
        """The item's rarest shingles, so many that a text without any of them lacks too much of the item to be similar."""
        out, missing = [], 0
        own = Counter(shingles.tolist())
        for h in sorted(own, key=lambda h: (holders[h], h)):
            out.append(h)
            missing += own[h]
            if len(shingles) - missing < self.similarity * len(shingles) - 1e-9:
                break
        return out

    def hits(self, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, words, bits, similarity) of the best window of each item that a text of these words copies."""
        best: dict[int, tuple[float, int, int]] = {}
        for width, (keys, places, seen) in self.places.items():
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            k = np.flatnonzero(seen[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(k):
                continue
            pos = np.minimum(np.searchsorted(keys, shingles[k]), len(keys) - 1)
            items = {i for at in np.unique(pos[keys[pos] == shingles[k]]).tolist() for i in places[at]}
            self._compare_whole(shingles, {i for i in items if self.size[i] > len(words)}, best)
            order = np.argsort(shingles, kind="stable")
            ranked = shingles[order]
            for i in sorted(items):
                if self.size[i] <= len(words):
                    self._compare(shingles, order, ranked, i, best)
        return [(self.ids[i], start, min(self.size[i], len(words)), bits, sim) for i, (sim, start, bits) in sorted(best.items())]

    def _compare_whole(self, shingles: np.ndarray, items: set[int], best: dict[int, tuple[float, int, int]]) -> None:
        """Compares a text as one window with longer items."""
        n = len(shingles)
        items = {i for i in items if n >= self.similarity * len(self.shingles[i])}
        if not items:
            return
        mine, own = Counter(shingles.tolist()), simhash_windows(shingles, np.array([0]), n)[0]
        for i in items:
            both = sum((mine & Counter(self.shingles[i].tolist())).values())
            sim = both / (n + len(self.shingles[i]) - both)
            if sim >= self.similarity:
                best[i] = (sim, 0, int(np.bitwise_count(own ^ self.prints[i])))

    def _compare(self, shingles: np.ndarray, order: np.ndarray, ranked: np.ndarray, i: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Compares the windows of a text with an item that is not longer; order sorts the text's shingles, ranked has them so."""
        own, n = Counter(self.shingles[i].tolist()), len(self.shingles[i])
        wanted = np.array(sorted(own), dtype=np.uint64)
        lo, hi = (np.searchsorted(ranked, wanted, side=side) for side in ("left", "right"))
        at = np.sort(order[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())])
        # A window is similar only if so many of its places hold shingles of the item.
        need = max(1, int(np.ceil(2 * n * self.similarity / (1 + self.similarity) - 1e-9)))
        first, last = at[: len(at) - need + 1], at[need - 1 :]
        close = last - first < n
        spans = zip(np.maximum(last[close] - n + 1, 0).tolist(), np.minimum(first[close], len(shingles) - n).tolist(), strict=True)
        starts = np.array(sorted({s for a, b in _merged(spans) for s in range(a, b + 1)}), dtype=np.int64)
        if not len(starts):
            return
        prints = simhash_windows(shingles, starts, n)
        bits = 64 // BLOCKS
        listed = np.zeros(len(starts), bool)
        for b in range(BLOCKS):
            values = ((prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1)).tolist()
            listed |= np.fromiter((i in self.blocks.get((self.size[i], b, v), ()) for v in values), bool, len(values))
        differ = np.bitwise_count(prints ^ self.prints[i])
        near = listed & (differ <= self.radius)
        common = _common(shingles, at, own, starts, n)
        sim = common / (2 * n - common)
        ok = np.flatnonzero(near & (sim >= self.similarity))
        if len(ok):
            k = ok[np.argmax(sim[ok])]
            best[i] = (float(sim[k]), int(starts[k]), int(differ[k]))


def _merged(spans: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans (both ends included) in ascending order, those that touch as one."""
    now: tuple[int, int] | None = None
    for a, b in spans:
        if a > b:
            continue
        if now is not None and a <= now[1] + 1:
            now = (now[0], max(now[1], b))
        else:
            if now is not None:
                yield now
            now = (a, b)
    if now is not None:
        yield now


def _common(shingles: np.ndarray, at: np.ndarray, own: Counter, starts: np.ndarray, n: int) -> np.ndarray:
    """How many shingles (repeats count) each window has in common with an item: only its places `at` matter, and each enters and leaves once."""
    held: Counter = Counter()
    both = enter = leave = 0
    places, found = at.tolist(), shingles[at].tolist()
    out = np.zeros(len(starts), np.int64)
    for k, start in enumerate(starts.tolist()):
        while enter < len(places) and places[enter] < start + n:
            h = found[enter]
            held[h] += 1
            both += held[h] <= own[h]
            enter += 1
        while leave < enter and places[leave] < start:
            h = found[leave]
            both -= held[h] <= own[h]
            held[h] -= 1
            leave += 1
        out[k] = both
    return out


def simhash_windows(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles at starts; a bit is 1 if it is set in over half of them."""
    lo, hi = int(starts[0]), int(starts[-1]) + n
    spread = mix64(shingles[lo:hi] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    ones = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(ones, axis=0, out=total[1:])
    inside = total[starts - lo + n] - total[starts - lo]
    return ((2 * inside > n) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _n_passes(benchmark: DataFrame, text_col: str) -> int:
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // PASS_BYTES))


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, in lists of at most about PASS_BYTES."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    n = _n_passes(benchmark, text_col)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, x))


def copied_items(text: Column | str, shared: Broadcast) -> Column:
    """HITS of each text: the items of the broadcast index that it copies, each with its best window (the first of equal ones)."""

    @F.arrow_udf(HITS)
    @lean
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("bits", pa.int32()), ("similarity", pa.float64())]))
        for batch in texts:
            raw_all, offsets_all = text_buffer(pc.utf8_lower(batch))
            out: list[list[dict]] = []
            for lo, hi in chunks(offsets_all):
                base = offsets_all[lo]
                raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
                starts, ends, before = word_spans(raw, offsets, _GAP)
                words = span_hashes(raw, starts, ends)
                may = _rows_with_shingle(index, words, before)
                for r in range(hi - lo):
                    got = index.hits(words[before[r] : before[r + 1]]) if may[r] else []
                    out.append([dict(zip(("item_id", "start", "words", "bits", "similarity"), x, strict=True)) for x in got])
            yield pa.array(out, kind)

    return of(text)


def _rows_with_shingle(index: ItemIndex, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which rows hold a shingle of some item; a shingle that runs over two rows may call a row needlessly."""
    may = np.zeros(len(before) - 1, bool)
    for width, (keys, _, seen) in index.places.items():
        shingles = shingle_hashes(words, width)
        k = np.flatnonzero(seen[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(k):
            k = k[keys[np.minimum(np.searchsorted(keys, shingles[k]), len(keys) - 1)] == shingles[k]]
            may[np.searchsorted(before, k, side="right") - 1] = True
    return may


def with_copied_items(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs with a column `name` of HITS, which replaces one of that name.

    Null and empty texts and items copy nothing; items of equal text each count, items without an id have a null item_id.
    Rows are judged one by one, so repeated rows and ids make no difference; empty tables give no hits. With several passes
    hits are carried by a 64-bit hash of the text.
    """
    sc = docs.sparkSession.sparkContext
    text = F.col(text_col).cast("string")
    passes = [items for items in _passes(benchmark, item_col, item_text_col) if items] if _n_passes(benchmark, item_text_col) == 1 else None
    if passes is not None:
        return docs.withColumn(name, copied_items(text, sc.broadcast(ItemIndex(passes[0], similarity, radius))) if passes else F.array().cast(HITS))
    found: list[DataFrame] = []
    for items in _passes(benchmark, item_col, item_text_col):
        shared = sc.broadcast(ItemIndex(items, similarity, radius))
        hits = docs.select(F.xxhash64(text).alias("text_hash"), copied_items(text, shared).alias("hits"))
        found.append(park(hits.filter("size(hits) > 0").dropDuplicates(["text_hash"])))
        shared.destroy()
    hash_, hits = unused(docs.columns, "text_hash", "hits")
    each = reduce(DataFrame.unionByName, found).groupBy("text_hash").agg(F.flatten(F.collect_list("hits")).alias(hits)).withColumnRenamed("text_hash", hash_)
    rows = docs.withColumn(hash_, F.xxhash64(text)).join(if_small(park(each)), hash_, "left")
    return rows.withColumn(name, F.coalesce(F.col(hits), F.array().cast(HITS))).select(*every(docs, name), name)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that copy no item, with the columns of docs, whatever their names; see `with_copied_items`."""
    (name,) = unused(docs.columns, "copied_items")
    return with_copied_items(docs, benchmark, name, text_col, similarity=similarity).filter(F.size(name) == 0).select(*every(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: each document and item that it copies, with the best window (first word, words), bits and similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_copied_items(docs, table(spark, sf_dir, "benchmark"), "hits")
    # explode would add a filter on the column, and with it a second evaluation of the windows.
    return found.select("doc_id", F.explode_outer("hits").alias("h")).filter("h is not null").select("doc_id", "h.*")


QUERIES = {"op1_simhash_decontamination": query}
