"""What the training-data operators share: tables, lineage cuts, and word arrays over Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table with more rows than this is joined by a shuffle; the others are counted and broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of text that the array code handles at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where none is set.

    A temporary folder is of use only where all tasks run on this machine; elsewhere the setting must be made.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            if not (spark.sparkContext.master or "").split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            known = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir() or known
    return known


def park(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and a lost executor costs no earlier stage.

    What is written stays until `clean`, as frames that are not yet computed may read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/park-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables and files that operators have written to the shared folder; frames that read them cannot be computed any more."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    store = paths.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.listStatus(paths):
        if found.getPath().getName().split("-")[0] in ("park", "tokens", "shards", "warc", "pipeline"):
            store.delete(found.getPath(), True)


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has `most` rows at most; it should be parked, as it is counted."""
    return F.broadcast(df) if df.count() <= most else df


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of that very name, whatever dots or backticks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(docs: DataFrame, but: str | None = None) -> list[Column]:
    """The columns of docs, without the one called `but`."""
    return [named(c) for c in docs.columns if but is None or c.lower() != but.lower()]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(no_id, id, text_hash): what tells rows apart, in the order in which they are preferred: ids first, null ids last, then a hash of the text."""
    id_ = F.col(id_col).cast("long")
    return [id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.lit(77), F.col(text_col).cast("string")).alias("text_hash")]


def first_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, of each group only the first one, with the columns of docs.

    rows has (no_id, id, text_hash, root) for each row of docs, root naming the group. First is the smallest id, a null id
    after all others; of equal ids the smaller hash of the text; of equal texts the row that is the smaller one as JSON.
    """
    key = ["no_id", "id", "text_hash"]
    each = park(rows.groupBy("root", *key).agg(F.count("*").alias("n")))
    first = each.groupBy("root").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("kinds"), F.max("n").alias("most"))
    first = if_small(park(first.filter("kinds > 1 or most > 1").select("root", "first")))
    known = each.join(first, "root").select(*key, "n", (F.struct(*key) == F.col("first")).alias("stays"))
    known = park(known.filter("not stays or n > 1"))
    names = unused(docs.columns, *key)
    docs_key = dict(zip(key, names, strict=True))
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), names, strict=True)))

    def among(some: DataFrame) -> DataFrame:
        return if_small(some.select(*(F.col(k).alias(n) for k, n in docs_key.items())).distinct())

    kept = keyed.join(among(known.filter("not stays")), names, "left_anti")
    twice = known.filter("stays")
    if not twice.isEmpty():
        again = among(twice)
        whole = F.struct(*every(docs))
        one = kept.join(again, names, "left_semi").groupBy(*names).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        kept = kept.join(again, names, "left_anti").select(*every(docs)).unionByName(one.select("row.*"))
    return kept.select(*every(docs))


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and each row's offsets in them; a null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_RNG = np.random.default_rng(0x5EED)
_BYTE_CODE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = n + n // 8
        with np.errstate(over="ignore"):
            for k, step in enumerate((_STEP, _STEP_INV)):
                grown = np.full(m, step, np.uint64)
                grown[0] = 1
                _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def lean(of: Callable) -> Callable:
    """of, a function of batches, whose task gives back at its end the memory that it has used.

    Workers are kept for later tasks, also of stages without Python; what they have freed would stay theirs.
    """

    @wraps(of)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from of(batches)
        finally:
            _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_map(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What a table of 256 one-byte values has for each byte."""
    return np.frombuffer(bytearray(raw.tobytes().translate(table.tobytes())), table.dtype)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside `gap`) of all rows, and for each row the number of words before it.

    Words also end before the places in `cuts`.
    """
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = byte_map(raw, ~gap)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a row's end also ends its last word
    if cuts is not None:
        edge[cuts] = True
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1] | edge[1:n])))
    ends = np.flatnonzero(word & np.concatenate((~word[1:] | edge[1:n], [True]))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class SpanHasher:
    """64-bit hashes of spans of one buffer: polynomials in one odd base, taken from running sums, then mixed.

    With `of`, a boolean for each byte value, only these bytes count, and where they stand does not.
    """

    def __init__(self, raw: np.ndarray, of: np.ndarray | None = None):
        self.total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            if of is None:
                up, self.down = _power_tables(len(raw) + 1)
                np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=self.total[1:])
            else:
                self.down = None
                np.cumsum(np.where(of, _BYTE_CODE, np.uint64(0))[raw], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = self.total[ends] - self.total[starts]
            return mix64(sums if self.down is None else sums * self.down[starts])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans up to this length are hashed by words of eight bytes, longer ones by SpanHasher.
_BY_WORDS = 64


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(raw)
    padded = np.zeros(-(-n // 8) * 8 + 80, np.uint8)
    padded[:n] = raw
    eights = padded.view("<u8")
    length = ends - starts

    def load(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        got = eights.take(word) >> shift
        got |= (eights.take(word + 1) << np.uint64(1)) << (np.uint64(63) - shift)
        return got & _MASKS.take(np.minimum(size, 8))

    with np.errstate(over="ignore"):
        out = mix64(load(starts, length) ^ (length.astype(np.uint64) * _STEP))
        for k in range(8, _BY_WORDS, 8):
            more = (length > k).nonzero()[0]
            if not len(more):
                return out
            out[more] = mix64(out[more] * np.uint64(3) + load(starts[more] + k, length[more] - k))
        more = (length > _BY_WORDS).nonzero()[0]
        if len(more):
            out[more] = SpanHasher(raw)(starts[more], ends[more])
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; their order within a run counts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = mix64(out * np.uint64(3) + words[k : k + n])
        return out
