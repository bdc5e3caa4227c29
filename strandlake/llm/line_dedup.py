"""Line dedup: near-equal lines by a segment-partition edit join.

Two lines are near-equal if their edit distance is EDITS at most, and at most SHARE of the longer one's bytes, so that
"Yes." does not stand for "No.": a line of 20 bytes bears two edits, one of 10 bytes one, a shorter one none. With a share
of 1 the number of edits alone counts, for lines of any length.

Two lines within EDITS edits share a segment: cut one into EDITS + 1 segments, and an edit can spoil but one of them. So
every line puts its segments into an index by line length, segment number and content, and probes the index, for its own
and shorter lengths, with those of its substrings that can match (their places are bounded by the edits on either side).
Pairs that meet are verified by banded bit-parallel edit distance. Components of the remaining links are the classes; of
each class the first line in order of (document, line) stays.

Many lines may share a segment, as in a template. So each entry also carries a sketch of its line: the byte values are dealt
into CLASSES classes, and the counts of each class are hashed to a few bits. An edit changes the counts of two byte values at
most, so lines within EDITS edits agree on all classes but 2 * EDITS; other pairs are not sent on. A segment of more than
HOT entries is dealt out anew: with the classes in 2 * EDITS + 1 groups, near lines agree on a whole group, so the entries
meet by segment and group, in pairs of slices where there are still many, and the tasks that compare them have the lines
at hand and send on true links only, a spanning forest of them.

Lines are identified by a 64-bit hash of their bytes, so that texts stay where they are: only the lines that meet another
are shuffled as text. Edits are of UTF-8 bytes. Lines without a word are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, byte_map, chunks, every, if_small, mix64, park, row_key, span_hashes, SpanHasher, table, text_buffer, unused, word_spans
from .near_dedup import _roots, components
from .url_filter import _filter_of, _in

EDITS = 2
#: Most edits as a share of the longer line's bytes.
SHARE = 0.1
#: Most entries of a segment that one task compares at once.
HOT = 4000
#: Lines that a task remembers to have sent.
SENT = 1 << 18
#: Most ids that a Bloom filter keeps for the look-up of texts; more are looked up by a join alone.
FILTER_IDS = 20_000_000
#: Classes of byte values in a line's sketch; 2 * EDITS must be fewer.
CLASSES = 10
#: Cells of a batch of pairs in the verification.
CELLS = 2 << 20
#: Bytes of texts, and pairs that meet, that a task handles at once: each stage has workers of its own, and all of them keep memory.
CHUNK, PAIRS = 1 << 19, 1 << 18

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_WORD = ~SPACE


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and numbers within the row (counting all lines, from 0) of the lines that hold a word."""
    starts, ends, before = word_spans(raw, offsets, _NEWLINE)
    heads = np.concatenate(([0], np.cumsum(byte_map(raw, _WORD))))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    breaks = np.concatenate(([0], np.cumsum(byte_map(raw, _NEWLINE))))
    number = breaks[starts] - breaks[offsets[rows]] if len(starts) else starts
    keep = heads[ends] > heads[starts]
    return starts[keep], ends[keep], rows[keep], number[keep]


KEY = "no_id boolean, id long, text_hash long"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(no_id, id, text_hash, line, name): every line with a word; name is the hash of its bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, offsets_all = text_buffer(batch.column(3))
            for lo, hi in chunks(offsets_all, CHUNK):
                base = offsets_all[lo]
                raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
                starts, ends, rows, number = _lines(raw, offsets)
                names = span_hashes(raw, starts, ends).view(np.int64)
                key = [batch.column(k).slice(lo, hi - lo).take(pa.array(rows)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*key, pa.array(number.astype(np.int32)), pa.array(names)], ["no_id", "id", "text_hash", "line", "name"])

    return docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string")).mapInArrow(find, f"{KEY}, line int, name long")


def _cut(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of segment i (from 0) of lines of the given lengths: even segments, the longer ones last."""
    small, more = length // (edits + 1), length % (edits + 1)
    longer = np.maximum(0, i - (edits + 1 - more))
    return i * small + longer, small + (i >= edits + 1 - more)


def segment_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int = EDITS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(lines, keys, probe): keys of the lines' segments, and of the substrings that they probe the index with."""
    length, spans = ends - starts, SpanHasher(raw)
    every = np.arange(len(starts))
    for i in range(edits + 1):
        at, size = _cut(length, i, edits)
        yield every, _key(spans, starts + at, size, length, i), False
        for shorter in range(edits + 1):
            other = length - shorter
            at, size = _cut(other, i, edits)
            lo, hi = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for shift in range(lo, hi + 1):
                fits = (other >= 0) & (at + shift >= 0) & (at + shift + size <= length)
                yield every[fits], _key(spans, (starts + at + shift)[fits], size[fits], other[fits], i), True


def _key(spans: SpanHasher, starts: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(spans(starts, starts + size) + mix64(length.astype(np.uint64) * np.uint64(64) + np.uint64(i)))


def sketches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line the hashed counts of the byte values of each class, side by side in one number."""
    bits = 60 // CLASSES
    out = np.zeros(len(starts), np.uint64)
    for c in range(CLASSES):
        counts = SpanHasher(raw, np.arange(256) % CLASSES == c)
        out |= (counts(starts, ends) >> np.uint64(64 - bits)) << np.uint64(c * bits)
    return out


def agree(a: np.ndarray, b: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Which pairs of sketches may be of lines within `edits` edits."""
    bits = 60 // CLASSES
    differ = a.view(np.uint64) ^ b.view(np.uint64)
    same = np.zeros(len(a), np.int8)
    for c in range(CLASSES):
        same += (differ >> np.uint64(c * bits)) & np.uint64((1 << bits) - 1) == 0
    return same >= CLASSES - 2 * edits


MET = "a long, b long, key long, probe boolean, sketch long"


def _batch(a: np.ndarray, b: np.ndarray | None = None, key: np.ndarray | None = None, probe: np.ndarray | None = None, sketch: np.ndarray | None = None) -> pa.RecordBatch:
    kinds = zip((a, b, key, probe, sketch), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), t) if x is None else pa.array(x, t) for x, t in kinds], ["a", "b", "key", "probe", "sketch"])


def meeting_pairs(key: np.ndarray, ids: np.ndarray, probe: np.ndarray, sketch: np.ndarray, edits: int = EDITS, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """MET: a and b are ids of an index entry and a probe of one key whose sketches agree, PAIRS of them taken up at once.

    Of a key with more than `hot` entries the entries themselves come back: a is the id, b is null.
    """
    if len(key) < 2:
        return
    order = np.lexsort((ids, probe, key))
    key, ids, probe, sketch = key[order], ids[order], probe[order], sketch[order]
    again = np.concatenate(([False], (key[1:] == key[:-1]) & (ids[1:] == ids[:-1]) & (probe[1:] == probe[:-1])))
    key, ids, probe, sketch = key[~again], ids[~again], probe[~again], sketch[~again]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(first[1:], len(key))
    large = np.repeat(last - first > hot, last - first)
    if large.any():
        yield _batch(ids[large], None, key[large], probe[large], sketch[large])
    split = first + np.add.reduceat((~probe).astype(np.int64), first)  # index entries stand before probes
    kept, probing = split - first, last - split
    alone = (kept == 1) & (probing == 1) & (ids[first] == ids[last - 1])
    runs = np.flatnonzero((kept > 0) & (probing > 0) & ~alone & (last - first <= hot))
    rows = kept[runs]  # a row is an index entry with its key's probes
    k = np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)
    run = np.repeat(runs, rows)
    entry, start, n = first[run] + k, split[run], probing[run]
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        some, at = slice(at, stop), stop
        i = np.repeat(entry[some], n[some])
        j = np.repeat(start[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(len(i))
        close = (ids[i] != ids[j]) & agree(sketch[i], sketch[j], edits)
        x, y = ids[i[close]], ids[j[close]]
        if len(x):
            both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            yield _batch(both[0], both[1])


def _shortest(edits: int, share: float) -> int:
    """The length below which a line has no near-equal one."""
    n = 0
    while not any(share * (n + e) >= e for e in range(1, edits + 1)):
        n += 1
    return n


def meeting_lines(docs: DataFrame, text_col: str = "text", edits: int = EDITS, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """MET: ids of different lines, a < b, that meet in the segment index, and the entries of its large segments."""
    shortest = _shortest(edits, share)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(SENT, np.uint64)  # of this task, so that a very common line is sent about once by each task
        for batch in batches:
            raw_all, offsets_all = text_buffer(batch.column(0))
            for lo, hi in chunks(offsets_all, CHUNK):
                base = offsets_all[lo]
                raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
                starts, ends, _, _ = _lines(raw, offsets)
                long = ends - starts >= shortest
                starts, ends = starts[long], ends[long]
                ids = span_hashes(raw, starts, ends)
                slot = (ids & np.uint64(SENT - 1)).astype(np.int64)
                new = np.flatnonzero(sent[slot] != ids)
                sent[slot[new]] = ids[new]
                ids, starts, ends = ids[new], starts[new], ends[new]
                sketch = sketches(raw, starts, ends)
                for which, key, probe in segment_keys(raw, starts, ends, edits):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[which].view(np.int64)), pa.array(np.full(len(key), probe)), pa.array(sketch[which].view(np.int64))], ["key", "id", "probe", "sketch"])

    dealt = docs.select(F.col(text_col).cast("string")).mapInArrow(keys, "key long, id long, probe boolean, sketch long")
    dealt = dealt.repartition(F.col("key")).sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        large = None  # a key that has shown to be large: its further entries are handed on as they come
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if large is not None:
                n = int(np.searchsorted(now[0], large, side="right"))
                if n:
                    yield _batch(now[1][:n], None, now[0][:n], now[2][:n], now[3][:n])
                now = [x[n:] for x in now]
            if not len(now[0]):
                continue
            large = None
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            whole = int(np.searchsorted(now[0], now[0][-1]))
            yield from meeting_pairs(*(x[:whole] for x in now), edits, hot)
            held = [x[whole:] for x in now]
            if len(held[0]) > 4 * hot:  # repeated entries may be among them, so this is not the exact limit
                large = held[0][0]
                yield _batch(held[1], None, held[0], held[2], held[3])
                held = [x[:0] for x in held]
        yield from meeting_pairs(*held, edits, hot)

    return dealt.mapInArrow(meet, MET)


def within_edits(first: list[bytes], second: list[bytes], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within `edits` edits (3 at most), by bit-parallel columns of a band.

    Bit k of a column j stands for row j - edits + k. A column's vertical differences, moved down by a row, give the next
    one's; the value is followed along the diagonal that ends in the last cell. Rows above the text count as j - row.
    """
    n = len(first)
    out = np.zeros(n, bool)
    swap = [len(a) < len(b) for a, b in zip(first, second, strict=True)]
    first, second = [b if s else a for a, b, s in zip(first, second, swap, strict=True)], [a if s else b for a, b, s in zip(first, second, swap, strict=True)]
    rows, columns = np.fromiter(map(len, first), np.int64, n), np.fromiter(map(len, second), np.int64, n)
    order = np.argsort(columns, kind="stable")
    order = order[rows[order] - columns[order] <= edits]
    at = 0
    while at < len(order):
        width = int(rows[order[min(len(order), at + max(1, CELLS // (int(columns[order[at]]) + 64))) - 1]]) + 2 * edits + 2
        some = order[at : at + max(1, CELLS // width)]
        out[some] = _band([first[k] for k in some], [second[k] for k in some], rows[some], columns[some], edits) <= edits
        at += len(some)
    return out


def _band(first: list[bytes], second: list[bytes], rows: np.ndarray, columns: np.ndarray, edits: int) -> np.ndarray:
    wide, tall = int(columns.max()), int(rows.max()) + 2 * edits + 2
    lead = b"\0" * (edits + 1)
    a = np.ascontiguousarray(np.frombuffer(b"".join((lead + x).ljust(tall + edits + 1, b"\0") for x in first), np.uint8).reshape(len(first), -1).T)
    b = np.ascontiguousarray(np.frombuffer(b"".join(x.ljust(wide, b"\1") for x in second), np.uint8).reshape(len(first), -1).T)
    full = np.uint8((1 << (2 * edits + 1)) - 1)
    top = np.uint8(1 << (2 * edits))
    diagonal = (edits + rows - columns).astype(np.uint8)
    score = np.abs(rows - columns)
    vn = np.full(len(first), (1 << (edits + 1)) - 1, np.uint8)
    vp = full ^ vn
    for j in range(1, wide + 1):
        vp, vn = (vp >> 1) | top, vn >> 1
        equal = np.zeros(len(first), np.uint8)
        for k in range(2 * edits + 1):  # row j - edits + k lies at place row + edits of a
            equal |= (a[j + k] == b[j - 1]).astype(np.uint8) << np.uint8(k)
        d0 = ((((equal & vp) + vp) ^ vp) | equal | vn) & full
        score += ((d0 >> diagonal) & 1 == 0) & (columns >= j)
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        down = (hp << 1) & full
        vp, vn = (((hn << 1) & full) | (~(d0 | down) & full)), d0 & down
    return score


def _near(first: list[bytes], second: list[bytes], edits: int, share: float) -> np.ndarray:
    """Whether each pair is within `edits` edits and `share` of the longer line."""
    if not first:
        return np.zeros(0, bool)
    longer = np.maximum(np.fromiter(map(len, first), np.int64, len(first)), np.fromiter(map(len, second), np.int64, len(second)))
    budget = np.minimum(edits, np.floor(share * longer + 1e-9)).astype(np.int64)
    out = np.zeros(len(first), bool)
    for e in range(1, edits + 1):
        of = np.flatnonzero(budget == e)
        if len(of):
            out[of] = within_edits([first[k] for k in of], [second[k] for k in of], e)
    return out


def _lines_by_name(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(id, line): the bytes of the wanted lines (`id`, parked)."""
    n = wanted.count()
    words = _filter_of(wanted.select(F.col("id").alias("a"), F.col("id").alias("b")), n, 0) if 0 < n <= FILTER_IDS else None

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, offsets_all = text_buffer(batch.column(0))
            for lo, hi in chunks(offsets_all, CHUNK):
                base = offsets_all[lo]
                raw, offsets = raw_all[base : offsets_all[hi]], offsets_all[lo : hi + 1] - base
                starts, ends, _, _ = _lines(raw, offsets)
                ids = span_hashes(raw, starts, ends).view(np.int64)
                if words is not None:
                    keep = _in(words, ids, ids, 0)
                    ids, starts, ends = ids[keep], starts[keep], ends[keep]
                ids, at = np.unique(ids, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([raw[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())], ["id", "line"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(texts, "id long, line binary").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))


def _links_of_large(entries: DataFrame, lines: DataFrame, edits: int, share: float, hot: int) -> DataFrame:
    """(a, b): links that join the near lines of the large segments' entries (MET), the lines being (id, line)."""
    bits, groups = 60 // CLASSES, 2 * edits + 1
    if groups > CLASSES:
        raise ValueError(f"{edits} edits need {groups} classes")

    def values(g: int) -> Column:
        """The sketch's classes of group g, side by side."""
        of = [F.shiftrightunsigned("sketch", c * bits).bitwiseAND(F.lit((1 << bits) - 1)) for c in range(g, CLASSES, groups)]
        return F.xxhash64(F.lit(g), *of)

    dealt = entries.select(F.col("a").alias("id"), "key", "probe", "sketch").distinct()
    dealt = park(dealt.select("id", "probe", "sketch", F.explode(F.array(*(F.xxhash64("key", values(g)) for g in range(groups)))).alias("cell")))
    large = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("probe").alias("probes"), F.min("probe").alias("kept")).filter("probes and not kept")
    large = if_small(park(large.select("cell", F.ceil(F.col("n") * 2 / hot).alias("slices"))))
    dealt = dealt.join(large, "cell")
    mine = F.pmod(F.xxhash64("id"), F.col("slices"))
    # An index entry's slice is a row of the square of slices, a probe's is a column.
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda k: F.when(F.col("probe"), k * F.col("slices") + mine).otherwise(mine * F.col("slices") + k))
    dealt = dealt.select("id", "probe", "sketch", "cell", F.explode(places).alias("pair")).select("id", "probe", "sketch", F.xxhash64("cell", "pair").alias("task"))
    dealt = dealt.join(lines, "id").select("task", "id", "probe", "sketch", "line").repartition(F.col("task")).sortWithinPartitions("task")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            task = now.column(0).to_numpy()
            whole = int(np.searchsorted(task, task[-1])) if len(task) else 0
            yield from compare(now.slice(0, whole))
            held = now.slice(whole)
        if held is not None:
            yield from compare(held)

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        task, ids, probe, sketch = (rows.column(k).to_numpy() for k in range(4))
        edges = np.flatnonzero(np.diff(task)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(task)], strict=True):
            index, probes = lo + np.flatnonzero(~probe[lo:hi]), lo + np.flatnonzero(probe[lo:hi])
            if not len(index) or not len(probes):
                continue
            names, row = np.unique(ids[lo:hi], return_inverse=True)
            text = rows.column(4).slice(lo, hi - lo).to_pylist()
            labels = np.arange(len(names))
            step = max(1, PAIRS // len(probes))
            for at in range(0, len(index), step):
                i, j = (x.reshape(-1) for x in np.meshgrid(index[at : at + step], probes, indexing="ij"))
                open_ = (labels[row[i - lo]] != labels[row[j - lo]]) & agree(sketch[i], sketch[j], edits)
                i, j = i[open_] - lo, j[open_] - lo
                near = _near([text[k] for k in i.tolist()], [text[k] for k in j.tolist()], edits, share)
                if near.any():
                    labels = _roots(labels, row[i[near]], row[j[near]])
            k = np.flatnonzero(labels != np.arange(len(labels)))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(names[labels[k]])], ["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long")


def close_lines(docs: DataFrame, text_col: str = "text", edits: int = EDITS, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """(a, b): links between different lines that join exactly the components of all near-equal lines."""
    met = park(meeting_lines(docs, text_col, edits, share, hot))
    pairs, large = park(met.filter("b is not null").select("a", "b").distinct()), met.filter("b is null")
    wanted = park(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select(F.col("a").alias("id"))).distinct())
    found = park(_lines_by_name(docs, wanted, text_col))
    both = pairs.join(found.withColumnRenamed("id", "a").withColumnRenamed("line", "line_a"), "a").join(found.withColumnRenamed("id", "b").withColumnRenamed("line", "line_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pa.array(_near(batch.column(2).to_pylist(), batch.column(3).to_pylist(), edits, share))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    links = both.select("a", "b", "line_a", "line_b").mapInArrow(verify, "a long, b long")
    return links if large.isEmpty() else links.unionByName(_links_of_large(large, found, edits, share, hot))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, share: float = SHARE) -> DataFrame:
    """(no_id, id, text_hash, line, name, class, first): every line with a word, its class (the smallest name in it), and the class's first line."""
    seen = park(occurrences(docs, id_col, text_col))
    roots = components(close_lines(docs, text_col, edits, share)).select(F.col("node").alias("name"), "root")
    each = seen.groupBy("name").agg(F.min(F.struct("no_id", "id", "text_hash", "line")).alias("first"))
    each = park(each.join(roots, "name", "left").select("name", F.coalesce("root", "name").alias("class"), "first"))
    firsts = each.groupBy("class").agg(F.min("first").alias("first"))
    each = each.select("name", "class").join(firsts, "class")
    return seen.join(each, "name").select("no_id", "id", "text_hash", "line", "name", "class", "first")


def _repeated(docs: DataFrame, id_col: str, text_col: str, edits: int, share: float) -> DataFrame:
    """(no_id, id, text_hash, n_lines, removed): for each document with a word its lines with one, and the numbers of those to remove."""
    lines = line_classes(docs, id_col, text_col, edits, share)
    again = F.struct("no_id", "id", "text_hash", "line") != F.col("first")
    return lines.groupBy("no_id", "id", "text_hash").agg(F.size(F.collect_set("line")).cast("long").alias("n_lines"), F.sort_array(F.collect_set(F.when(again, F.col("line")))).alias("removed"))


def with_repeated_lines(docs: DataFrame, n_lines: str, removed: str, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, share: float = SHARE) -> DataFrame:
    """docs with two columns more: the number of lines that hold a word, and the numbers (from 0, of all lines) of those to remove.

    A line goes if it is near-equal to an earlier one, through others if need be: in order of ids, null ids last, then of a
    hash of the text, then of lines. Rows of equal id and text are one document and are treated alike; other rows that share
    an id, or have none, are documents of their own. Null and empty texts, and an empty table, have no lines.
    """
    *key, own = unused(docs.columns, "no_id", "id", "text_hash", "lines")
    found = _repeated(docs, id_col, text_col, edits, share)
    found = found.select(*(F.col(a).alias(b) for a, b in zip(("no_id", "id", "text_hash"), key, strict=True)), F.struct("n_lines", "removed").alias(own))
    rows = docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), key, strict=True))).join(found, key, "left")
    return rows.select(*every(docs), F.coalesce(F.col(f"{own}.n_lines"), F.lit(0)).alias(n_lines), F.coalesce(F.col(f"{own}.removed"), F.array().cast("array<int>")).alias(removed))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, share: float = SHARE) -> DataFrame:
    """docs, their texts without the lines that `with_repeated_lines` finds, with the columns of docs, whatever their names."""
    n_lines, removed = unused(docs.columns, "n_lines", "removed")
    rows = with_repeated_lines(docs, n_lines, removed, id_col, text_col, edits, share)
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, k: ~F.array_contains(removed, k)), "\n")
    return rows.withColumn(text_col, left).select(*every(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: for each document its number of lines with a word, and the numbers of the lines that are removed."""
    rows = with_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_lines", "removed")
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


QUERIES = {"op4_segment_edit_lines": query}
