"""Block-compressed text (bgzip) as a data source: several tasks read one file, and a region reads its blocks alone.

Such a file is a run of small gzip members that carry their size, so a task can start at any of them. Partitions are byte
ranges of about `split` bytes; a task looks for the first block that begins in its range, by its signature and that of the
block after it, leaves the line that it comes into to the task before, and reads on to the end of its own last line. With an
index (a row for each block and chromosome: its first and last position) only blocks that can hold a region's lines are
read; the index is made by the same source. A filter on `chrom` and `pos` is pushed down to the reader in any case.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

NAME = "bgzip_lines"
SCHEMA = "file string, block long, chrom string, pos long, line string"
INDEX = "file string, block long, chrom string, first_pos long, last_pos long"
# The head of a block with its size field, the block that ends a file, and the most bytes that a block may hold.
HEAD = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 65_280
SPLIT = 64 << 20
#: Bytes that are read at once.
CHUNK = 1 << 20
#: Lines of a file that is written.
LINES = 1_000_000


def make_block(raw: bytes) -> bytes:
    """One block of at most MOST bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = len(body) + 26
    return HEAD + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with these bytes, null if none does."""
    if len(head) < 18 or head[:4] != HEAD:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(len(head), 12 + extra):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def _unpacked(raw: bytes) -> bytes:
    extra = struct.unpack_from("<H", raw, 10)[0]
    text = zlib.decompress(raw[12 + extra : -8], -15)
    crc, n = struct.unpack("<II", raw[-8:])
    if zlib.crc32(text) != crc or len(text) != n:
        raise ValueError("a block is damaged")
    return text


class _File:
    """Blocks of one file, read through a buffer of bounded size."""

    def __init__(self, store: FileSystem, path: str):
        self.source, self.size, self.at, self.held = store.open_input_file(path), store.get_file_info(path).size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.source.read_at(max(n, min(CHUNK, max(0, self.size - at))), at)
        return self.held[at - self.at : at - self.at + n]

    def first_block(self, lo: int, hi: int) -> int | None:
        """Where the first block in [lo, hi) begins: a signature that is followed by another one, or the file's end."""
        while lo < hi:
            window = self.bytes(lo, min(CHUNK, self.size - lo))
            k = window.find(HEAD)
            while k >= 0:
                at = lo + k
                if at >= hi:
                    return None
                n = block_size(self.bytes(at, min(64, self.size - at)))
                if n is not None and (at + n == self.size or block_size(self.bytes(at + n, min(64, max(0, self.size - at - n)))) is not None):
                    return at
                k = window.find(HEAD, k + 1)
            lo += max(1, len(window) - 3)
        return None

    def blocks(self, at: int | None) -> Iterator[tuple[int, bytes]]:
        """(offset, text) of the blocks from `at` on."""
        while at is not None and at < self.size:
            n = block_size(self.bytes(at, min(64, self.size - at)))
            if n is None:
                raise ValueError(f"no block begins at {at}")
            yield at, _unpacked(self.bytes(at, n))
            at += n

    def lines(self, lo: int, hi: int, skip: bool) -> Iterator[tuple[int, str]]:
        """(block, line) of the lines of the blocks from lo up to hi; a line is of the block that holds the byte before it.

        With skip, the block at lo is not a file's first one, and what comes up to the first line's end is of an earlier block.
        """
        rest, owner = b"", lo
        for at, text in self.blocks(lo):
            beyond = at >= hi
            if beyond and skip:
                return  # not one line begins after a byte of these blocks
            parts = (rest + text).split(b"\n")
            for k, line in enumerate(parts[:-1]):
                if skip:
                    skip = False
                    continue
                yield (owner if k == 0 else at), line.decode()
                if beyond:
                    return
            if len(parts) > 1:
                owner = at
            rest = parts[-1]
        if rest and not skip:
            yield owner, rest.decode()


def _files(path: str) -> list[tuple[str, int]]:
    store, root = FileSystem.from_uri(path)
    info = store.get_file_info(root)
    found = [info] if info.type == FileType.File else [x for x in store.get_file_info(FileSelector(root, recursive=True)) if x.type == FileType.File]
    return sorted((x.path, x.size) for x in found if x.base_name.endswith((".gz", ".bgz")) and x.size)


@dataclass
class _Range(InputPartition):
    """A byte range of a file, or with `blocks` these blocks of it."""

    file: str
    lo: int
    hi: int
    blocks: tuple[int, ...] | None = None


def _place(line: str) -> tuple[str | None, int | None]:
    """Chromosome and position of a tab-separated line; null for headers and others."""
    if line.startswith("#"):
        return None, None
    parts = line.split("\t", 2)
    return (parts[0], int(parts[1])) if len(parts) > 1 and parts[1].isdigit() else (None, None)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.index = options.get("blocks")  # file:block,block;... of the wanted blocks, as `read_lines` has picked them
        self.chrom: str | None = None
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        """Lines of other places are left out by the reader already; Spark tests the filters again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chrom = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("pos",):
                self.low = max(f.value, self.low) if self.low is not None else f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                self.high = min(f.value, self.high) if self.high is not None else f.value
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        if self.index is not None:
            out = []
            for part in filter(None, self.index.split(";")):
                file, _, numbers = part.rpartition(":")
                blocks = tuple(map(int, numbers.split(",")))
                out += [_Range(file, 0, 0, blocks[k : k + 256]) for k in range(0, len(blocks), 256)]
            return out or [_Range("", 0, 0)]
        ranges = [_Range(file, lo, min(size, lo + self.split)) for file, size in _files(self.path) for lo in range(0, size, self.split)]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = FileSystem.from_uri(self.path)
        file = _File(store, partition.file)
        if partition.blocks is not None:
            spans = [(b, b + 1, b > 0) for b in partition.blocks]
        else:
            first = file.first_block(partition.lo, partition.hi)
            spans = [(first, partition.hi, first > 0)] if first is not None else []
        for lo, hi, skip in spans:
            for block, line in file.lines(lo, hi, skip):
                chrom, pos = _place(line)
                if (self.chrom is None or chrom == self.chrom) and (self.low is None or (pos is not None and pos >= self.low)) and (self.high is None or (pos is not None and pos <= self.high)):
                    yield partition.file, block, chrom, pos, line


class BgzipSource(DataSource):
    """spark.read.format("bgzip_lines").load(path): lines of a file, or of all files of a folder, with their block and place."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, path: str, split: int = SPLIT, blocks: str | None = None) -> DataFrame:
    """(file, block, chrom, pos, line) of all lines; filters on chrom and pos are tested where the lines are read."""
    spark.dataSource.register(BgzipSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("split", split)
    return (reader if blocks is None else reader.option("blocks", blocks)).load(path)


def block_index(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """INDEX of the lines that begin in each block, a row for each chromosome in it; blocks without a placed line have none."""
    rows = read_lines(spark, path, split).filter("pos is not null")
    return rows.groupBy("file", "block", "chrom").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def read_region(spark: SparkSession, path: str, index: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(chrom, pos, line) of the lines from start to end, of the blocks that the index names."""
    near = index.filter((F.col("chrom") == chrom) & (F.col("first_pos") <= end) & (F.col("last_pos") >= start)).select("file", "block").distinct()
    by_file: dict[str, list[int]] = {}
    for r in near.collect():  # blocks of a region
        by_file.setdefault(r.file, []).append(r.block)
    wanted = ";".join(f"{f}:{','.join(map(str, sorted(b)))}" for f, b in sorted(by_file.items()))
    return read_lines(spark, path, blocks=wanted).filter((F.col("chrom") == chrom) & F.col("pos").between(start, end)).select("chrom", "pos", "line")


def files_for(lines: DataFrame, least: int = 1, each: int = LINES) -> int:
    """The number of files, one a task, of about `each` lines: what a task takes up does not grow with the table."""
    return max(least, -(-lines.count() // each))


def write_lines(lines: DataFrame, path: str, col: str = "value") -> int:
    """Writes text lines to a folder of block-compressed files, one a task, and gives their number; the order within a task stays."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, held, out = f"part-{uuid.uuid4().hex}.gz", b"", None
        for batch in batches:
            held += b"".join(x.encode() + b"\n" for x in batch.column(0).to_pylist() if x is not None)
            while len(held) >= MOST:
                out = out or store.open_output_stream(f"{root}/.{name}", compression=None)
                out.write(make_block(held[:MOST]))
                held = held[MOST:]
        if held or out is not None:
            out = out or store.open_output_stream(f"{root}/.{name}", compression=None)
            if held:
                out.write(make_block(held))
            out.write(END)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    names = [r.name for r in lines.select(col).mapInArrow(write, "name string").collect()]  # a row for each file
    store, root = FileSystem.from_uri(path)
    for name in names:  # files of lost tasks keep their hidden name
        store.move(f"{root}/.{name}", f"{root}/{name}")
    return len(names)
