"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more.

Candidates come from two searches. SimHash fingerprints of the shingles are joined by the trie of `near_dedup` under its
budget of RADIUS bits. At 0.8 some ten of 64 bits differ, and a trie with that budget prunes next to nothing. So the others
are found by min-hashes: BANDS bands of ROWS each, of which a pair at 0.8 shares one in all
but 5 in 100,000 cases. Texts of a band's cell compare sketches: a bit of each min-hash, which leaves out 1 in 100,000 at
0.8, and where these agree a byte of each, which leaves out as few. What remains is compared exactly, by shingle hashes.
Components of the true pairs are the groups.

Not all pairs of a large group are compared. A shingle that no other candidate has can't be shared, so the number of a
text's other shingles bounds its similarity with any text (`bound`); an edited copy has many shingles of its own. First
each text meets, of each cell, the likeliest text and the one with the highest bound, which is the least edited. Then only
texts meet that are still in different components, all of them that the sketch and the bound allow. Cells of more than
SLICE texts are dealt to tasks as pairs of slices, and a task takes up a bounded number of pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import chunks, first_of_each, if_small, lean, mix64, park, row_key, shingle_hashes, span_hashes, text_buffer, word_spans
from .near_dedup import RADIUS, components, hamming_links
from .url_filter import _filter_of, _in

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Least sketch bits of BANDS * ROWS on which likely pairs agree; a pair at 0.8 agrees on 112, with a deviation of 3.4.
AGREE = 97
#: Least bytes of the min-hashes on which they agree; at 0.8 it is 100 on average, with a deviation of 4.5.
SAME = 80
#: Most texts of a cell that one task compares; a larger cell is compared by pairs of slices of half this size.
SLICE = 4000
#: Pairs of sketches that a task compares at once.
PAIRS = 1 << 17
#: Most texts that a Bloom filter keeps for the look-up of shingles; more are looked up by a join alone.
FILTER_TEXTS = 20_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_FACTORS = np.random.default_rng(0xBA5D).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, names, shingles, offsets) of some rows at a time: a name is a hash of all words, zero words included.

    A-Z become a-z; words are runs outside ASCII white space; fewer words than WIDTH are one shingle. Shingles may repeat.
    """
    raw_all, offsets_all = text_buffer(texts)
    for lo, hi in chunks(offsets_all):
        base = offsets_all[lo]
        raw, offsets = _LOWER[raw_all[base : offsets_all[hi]]], offsets_all[lo : hi + 1] - base
        starts, ends, before = word_spans(raw, offsets)
        words = span_hashes(raw, starts, ends)
        names = np.array([xxhash.xxh64_intdigest(words[a:b].tobytes(), 5) for a, b in zip(before[:-1], before[1:], strict=True)], np.uint64)
        count = np.diff(before)
        total = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
        at = np.concatenate(([0], np.cumsum(total)))
        place = np.repeat(before[:-1] - at[:-1], total) + np.arange(at[-1])
        shingles = np.append(shingle_hashes(words, WIDTH), np.zeros(WIDTH, np.uint64))[place]
        for r in np.flatnonzero((count > 0) & (count < WIDTH)).tolist():
            shingles[at[r]] = shingle_hashes(words[before[r] : before[r + 1]], int(count[r]))[0]
        yield lo, names, shingles, at


def min_hashes(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (rows x BANDS), sketches (rows x 2 words) and a byte of each min-hash, of rows that have shingles."""
    with np.errstate(over="ignore"):
        least = np.stack([np.minimum.reduceat(shingles * f, offsets[:-1]) for f in _FACTORS], axis=1)
        cells = np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))
        for k in range(ROWS):
            cells = mix64(cells * np.uint64(3) + least[:, k::ROWS])
    mixed = mix64(least)
    bits = np.zeros((len(least), 128), np.uint8)
    bits[:, : BANDS * ROWS] = mixed & np.uint64(1)
    return cells, np.packbits(bits, axis=1).view(np.uint64), (mixed >> np.uint64(8)).astype(np.uint8)


def simhashes_of(shingles: np.ndarray, offsets: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each row: bit k is 1 if it is set in over half of the row's hashes; `most` hashes at a time."""
    n = np.diff(offsets)
    row, ones = np.repeat(np.arange(len(n)), n), np.zeros((len(n), 64), np.int64)
    for at in range(0, len(shingles), most):
        own = row[at : at + most]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(mix64(shingles[at : at + most]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return ((2 * ones > n[:, None]) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _longs(lists: np.ndarray, has: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(has * BANDS))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.reshape(-1).view(np.int64)))


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix of bytes."""
    n, wide = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * wide), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, wide: int) -> np.ndarray:
    """The matrix of bytes of a binary array whose values are all that long."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(n, wide)


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no_id, id, text_hash, text, cells, s0, s1, more, fp): each row's text by name, its cells, sketches and fingerprint; a text without words has no cells."""

    @lean
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, names, shingles, at in shingle_sets(batch.column(3)):
                has = np.diff(at) > 0
                sketch, more = np.zeros((len(names), 2), np.uint64), np.zeros((len(names), BANDS * ROWS), np.uint8)
                cells = np.zeros((0, BANDS), np.uint64)
                if has.any():
                    cells, sketch[has], more[has] = min_hashes(shingles, np.append(at[:-1][has], at[-1]))
                fp = pa.array(simhashes_of(shingles, at).view(np.int64))
                two = [pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in (0, 1)]
                key = [batch.column(k).slice(lo, len(names)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(names.view(np.int64)), _longs(cells, has), *two, _bytes(more), fp], ["no_id", "id", "text_hash", "text", "cells", "s0", "s1", "more", "fp"])

    return docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string")).mapInArrow(of, "no_id boolean, id long, text_hash long, text long, cells array<long>, s0 long, s1 long, more binary, fp long")


def _large_cells(texts: DataFrame, most: int) -> DataFrame:
    """(cell, slices) of the cells of more than `most` texts."""
    large = texts.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return if_small(park(large.select("cell", F.ceil(F.col("n") * 2 / most).alias("slices"))))


def _pieces(places: np.ndarray, most: int = 1 << 15) -> Iterator[np.ndarray]:
    """The places, some at a time, as wide rows are compared for each."""
    for at in range(0, len(places), most):
        yield places[at : at + most]


#: What `_met` looks for among the texts of a cell whose sketches agree.
ANY, BEST, REST = range(3)


def _met(texts: DataFrame, large: DataFrame, what: int, similarity: float) -> DataFrame:
    """(a, b): texts of a cell whose sketches and bounds agree.

    ANY: each text that meets another one, as a and b. BEST: each text and, of each of its cells, the likeliest text and
    that of the highest bound. REST: all pairs of different roots, a < b, each by the first cell that they share. texts has
    (text, s0, s1, cells, n, common, root), and but for ANY `more`.
    """
    columns = ["text", "s0", "s1", "n", "common", "root", *(["more"] if what != ANY else []), *(["names"] if what == REST else [])]
    if what == REST:  # 32 bits of each cell
        names = F.transform("cells", lambda c: F.hex(c.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)))
        texts = texts.withColumn("names", F.unhex(F.array_join(F.transform(names, lambda h: F.substring(h, 2, 8)), "")))
    dealt = texts.select(*columns, F.posexplode("cells").alias("band", "cell")).join(large, "cell", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    columns.append("band")
    mine = F.pmod(F.xxhash64("text"), F.col("slices"))

    def meets(k: Column) -> Column:
        return F.struct((F.least(k, mine) * F.col("slices") + F.greatest(k, mine)).alias("pair"), (k == mine).alias("within"))

    dealt = dealt.select("cell", *columns, mine.alias("own"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), meets)).alias("at"))
    dealt = dealt.select(F.xxhash64("cell", "at.pair").alias("task"), *columns, "own", "at.within")
    dealt = dealt.repartition(F.col("task")).sortWithinPartitions("task")

    order = ["task", *columns, "own", "within"]
    wide = {order.index(c): n for c, n in (("more", BANDS * ROWS), ("names", 4 * BANDS)) if c in order}

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [_rows(c, wide[k]) if k in wide else c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last group may go on
            yield from compare(*(x[:whole] for x in now))
            held = [x[whole:] for x in now]
        if held is not None:
            yield from compare(*held)

    def compare(*values: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = dict(zip(order, values, strict=True))
        task, text, s0, s1, size, common, root, band, own, within = (of[c] for c in ("task", "text", "s0", "s1", "n", "common", "root", "band", "own", "within"))
        more, names = of.get("more"), of["names"].view("<u4") if "names" in of and len(of["names"]) else None
        if len(task) < 2:
            return
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        new = np.concatenate(([True], task[1:] != task[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(task))
        which = np.cumsum(new) - 1
        lo, n = first[which], (last - first)[which]
        rows = np.flatnonzero(n > 1)
        ends = np.cumsum(n[rows])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            some, at = rows[at:stop], stop
            m = n[some]
            begin = np.cumsum(m) - m
            i = np.repeat(some, m)
            j = np.repeat(lo[some] - begin, m) + np.arange(len(i))
            alike = BANDS * ROWS - np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) - np.bitwise_count(s1[i] ^ s1[j])
            shared = np.minimum(common[i], common[j])
            bound = shared / (size[i] + size[j] - shared)
            fit = (i != j) & (alike >= AGREE) & (bound >= similarity - 1e-9) & (within[i] | (own[i] != own[j]))
            if what == REST:
                fit &= (i < j) & (root[i] != root[j])
            if more is not None:
                for k in _pieces(np.flatnonzero(fit)):
                    fit[k] = (more[i[k]] == more[j[k]]).sum(axis=1) >= SAME
            if what == REST:
                for k in _pieces(np.flatnonzero(fit)):
                    fit[k] = ~((names[i[k]] == names[j[k]]) & (np.arange(BANDS) < band[i[k]][:, None])).any(axis=1)
                x, y = text[i[fit]], text[j[fit]]
            else:
                x, y = [], []
                for by in (alike, np.rint(bound * (1 << 20)).astype(np.int64)):  # the first of the highest
                    rank = np.where(fit, by * len(task) + (len(task) - 1 - j), -1)
                    top = np.maximum.reduceat(rank, begin)
                    x.append(text[some[top >= 0]])
                    y.append(text[len(task) - 1 - top[top >= 0] % len(task)])
                x, y = np.concatenate(x), np.concatenate(y)
                if what == ANY:
                    y = x
            if len(x):
                both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def trie_pairs(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): texts whose fingerprints the trie links, as many as connect all that are within radius bits; texts has (text, fp)."""
    stands = park(texts.groupBy("fp").agg(F.min("text").alias("stand")))
    links, of = hamming_links(stands.select("fp"), radius), if_small(stands)
    for end in ("a", "b"):
        links = links.join(of.withColumnRenamed("fp", end), end).drop(end).withColumnRenamed("stand", end)
    same = texts.join(of, "fp").select(F.col("text").alias("a"), F.col("stand").alias("b")).filter("a != b")
    return links.select("a", "b").unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingles_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(text, shingles): the different shingles of the wanted texts (`text`, parked)."""
    n = wanted.count()
    known = _filter_of(wanted.select(F.col("text").alias("a"), F.col("text").alias("b")), n, 0) if 0 < n <= FILTER_TEXTS else None

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names, shingles, at in shingle_sets(batch.column(0)):
                ids = names.view(np.int64)
                keep = np.unique(ids, return_index=True)[1]
                if known is not None and len(keep):
                    keep = keep[_in(known, ids[keep], ids[keep], 0)]
                of = [np.unique(shingles[at[k] : at[k + 1]]).view(np.int64) for k in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(of, pa.list_(pa.int64()))], ["text", "shingles"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(sets, "text long, shingles array<long>").join(wanted, "text", "left_semi")
    return found.dropDuplicates(["text"])


def similar_pairs(sets: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of texts by name whose shingle sets are as similar as that."""
    both = pairs.join(sets.select(F.col("text").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("text").alias("b"), F.col("shingles").alias("set_b")), "b")

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-9:
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    ok[k] = shared >= similarity * (len(a) + len(b) - shared) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in (0, 1)], ["a", "b"])

    return both.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long")


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_size: int = SLICE, similarity: float = SIMILARITY) -> DataFrame:
    """(no_id, id, text_hash, root) of each row: root names its component, for any table of any size, an empty one included.

    Texts of the same words are in one component, those without words in one of their own; nulls have no words.
    """
    rows = park(prints(docs, id_col, text_col))
    texts = park(rows.groupBy("text").agg(*(F.first(c).alias(c) for c in ("cells", "s0", "s1", "more", "fp"))))
    near = park(trie_pairs(texts.filter(F.size("cells") > 0).select("text", "fp")))
    texts = texts.drop("fp")
    large = _large_cells(texts, slice_size)
    unknown = {"n": F.lit(1).cast("long"), "common": F.lit(1).cast("long"), "root": F.col("text")}
    any_ = _met(texts.withColumns(unknown), large, ANY, similarity).select(F.col("a").alias("text"))
    wanted = park(any_.unionByName(near.select(F.explode(F.array("a", "b")).alias("text"))).distinct())
    sets = park(shingles_of(docs, wanted, text_col))
    # A shingle of one text only counts for nothing; a text has each shingle once.
    each = sets.select("text", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle")
    common = each.join(shared, "shingle", "left_semi").groupBy("text").agg(F.count("*").alias("common"))
    sizes = sets.select("text", F.size("shingles").cast("long").alias("n")).join(common, "text")
    likely = park(texts.join(sizes, "text").withColumn("root", F.col("text")))
    tried = park(_met(likely, large, BEST, similarity).unionByName(near).distinct())
    links = park(similar_pairs(sets, tried, similarity))
    roots = components(links).withColumnRenamed("node", "text")
    rooted = park(likely.drop("root").join(roots, "text", "left").withColumn("root", F.coalesce("root", "text")))
    rest = park(_met(rooted, large, REST, similarity).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        further = park(similar_pairs(sets, rest, similarity))
        if not further.isEmpty():
            roots = components(links.unionByName(further)).withColumnRenamed("node", "text")
    return rows.select("no_id", "id", "text_hash", "text").join(if_small(park(roots)), "text", "left").select("no_id", "id", "text_hash", F.coalesce("root", "text").alias("root"))


def drop_similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of each group of similar texts one row, with the columns of docs.

    It is the first by `first_of_each`: the smallest id, null ids last, then by hash of the text, then by the other columns.
    Groups are of rows, so rows of one id (or without one) whose texts differ are in groups of their own. Null and empty
    texts are copies of each other; an empty table stays empty; columns may have any names.
    """
    return first_of_each(docs, similar_rows(docs, id_col, text_col), id_col, text_col)
