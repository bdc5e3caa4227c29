"""bigWig files: written by many tasks, read by region through the file's index.

Intervals are sorted over all tasks by a range shuffle; each task packs and compresses its blocks into a file of its own and
stores a row for each block. Summaries of coarser and coarser windows are aggregations, packed in the same way. The tree of
chromosomes, and for data and each summary level an R-tree with an entry for each block (a thousand items of a chromosome at
most), are packed by tasks too, but for their upper levels. What is put together in one place is the header; the tasks' files
are then appended to it, byte for byte, in pieces of bounded size.

A reader walks the tree to the blocks that overlap its regions, and leaves branches to tasks where they become many; tasks
fetch the blocks, near ones together.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

# The format's signatures and record layouts (little-endian).
MAGIC, CHROM_MAGIC, INDEX_MAGIC, VERSION = 0x888FFC26, 0x78CA8C91, 0x2468ACE0, 4
HEADER, ZOOM_HEADER, SUMMARY = "<IHHQQQHHQQIQ", "<IIQQ", "<Qdddd"
CHROM_HEADER, INDEX_HEADER, NODE = "<IIIIQQ", "<IIQIIIIQII", "<BBH"
SECTION = "<IIIIIBBH"
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
LEAF = np.dtype([("chrom_0", "<u4"), ("start", "<u4"), ("chrom_1", "<u4"), ("end", "<u4"), ("offset", "<u8"), ("size", "<u8")])
BRANCH = np.dtype([("chrom_0", "<u4"), ("start", "<u4"), ("chrom_1", "<u4"), ("end", "<u4"), ("offset", "<u8")])
ITEM = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
ZOOM = np.dtype([("chrom", "<u4"), ("start", "<u4"), ("end", "<u4"), ("valid", "<u4"), ("least", "<f4"), ("most", "<f4"), ("total", "<f4"), ("squares", "<f4")])

#: Items of a block, and children of a tree's node.
ITEMS, NODE_ITEMS = 1024, 256
#: Most summary levels, each four times as coarse as the one before.
LEVELS, COARSER = 8, 4
#: Bytes that are copied, or fetched for several blocks, at once; and bytes between two wanted blocks that are read all the same.
CHUNK, GAP = 8 << 20, 64 << 10
#: Entries of a level of a tree, and nodes of one, that the driver holds at most; beyond, they are the tasks'. Entries of a task.
HELD, NODES, DEALT = 1 << 13, 1 << 6, 1 << 17
#: Rows of small blocks that a reader sends on together.
ROWS = 8192

_BLOCKS = "part int, k long, file string, offset long, size long, raw long, chrom_id int, start long, end long"
_VALUES = ("start", "end", "value")
_SUMMARY = ("start", "end", "valid", "least", "most", "total", "squares")


@dataclass
class Blocks:
    """A row (part, k, offset, size, chrom_id, start, end) for each block, what is known of each task's blocks, in order, and all blocks' number and bytes, and the largest one's, unpacked."""

    rows: DataFrame
    parts: list[Row]
    n: int
    size: int
    largest: int
    raw: int


def _pack(rows: DataFrame, columns: Sequence[str], folder: str, parts: int) -> Blocks:
    """Writes rows (chrom_id, columns) in order to files of the tasks; the rows of their blocks are stored, and one row a task goes to the driver."""
    zoom = len(columns) > 3

    def block(chrom: int, x: np.ndarray) -> bytes:
        if zoom:
            out = np.zeros(len(x[0]), ZOOM)
            out["chrom"] = chrom
            for name, values in zip(columns, x, strict=True):
                out[name] = values
            return out.tobytes()
        out = np.zeros(len(x[0]), ITEM)
        for name, values in zip(columns, x, strict=True):
            out[name] = values
        return struct.pack(SECTION, chrom, int(x[0][0]), int(x[1][-1]), 0, 0, BED_GRAPH, 0, len(out)) + out.tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, name, out, at, k = TaskContext.get().partitionId(), f"blocks-{uuid.uuid4().hex}", None, 0, 0
        held: list[tuple[int, list[np.ndarray]]] = []  # of one chromosome

        def blocks(last: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
            """Whole blocks of what is held; the last one may be smaller."""
            nonlocal held
            if held:
                chrom = held[0][0]
                x = [np.concatenate([h[1][c] for h in held]) for c in range(len(columns))]
                n = len(x[0]) if last else len(x[0]) // ITEMS * ITEMS
                for lo in range(0, n, ITEMS):
                    yield chrom, [c[lo : min(n, lo + ITEMS)] for c in x]
                held = [(chrom, [c[n:] for c in x])] if n < len(x[0]) else []

        def put(made: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple]:
            nonlocal out, at, k
            for chrom, x in made:
                raw = block(chrom, x)
                packed = zlib.compress(raw)
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(packed)
                yield part, k, name, at, len(packed), len(raw), chrom, int(x[0].min()), int(x[1].max())
                at, k = at + len(packed), k + 1

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

        try:
            for batch in batches:
                chrom = batch.column(0).to_numpy()
                x = [batch.column(c + 1).to_numpy(zero_copy_only=False) for c in range(len(columns))]
                found: list[tuple] = []
                edges = [0, *(np.flatnonzero(chrom[1:] != chrom[:-1]) + 1).tolist(), len(chrom)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if hi > lo:
                        if held and held[0][0] != chrom[lo]:
                            found += put(blocks(last=True))
                        held.append((int(chrom[lo]), [c[lo:hi] for c in x]))
                        found += put(blocks(last=False))
                if found:
                    yield table(found)
            found = list(put(blocks(last=True)))
            if found:
                yield table(found)
        finally:
            if out is not None:
                out.close()

    dealt = rows.select("chrom_id", *columns).repartitionByRange(parts, "chrom_id", "start").sortWithinPartitions("chrom_id", "start")
    index = f"{folder}/index-{uuid.uuid4().hex}"
    dealt.mapInArrow(write, _BLOCKS).write.parquet(index)  # what lost tasks have written is in no row
    blocks = rows.sparkSession.read.schema(_BLOCKS).parquet(index)
    parts_ = blocks.groupBy("part", "file").agg(F.count("*").alias("n"), F.max("raw").alias("largest"), F.sum("raw").alias("raw"), F.sum("size").alias("size"), F.max("end").alias("end"), F.min(F.struct("k", "chrom_id", "start")).alias("first"), F.max(F.struct("k", "chrom_id")).alias("last")).orderBy("part").collect()
    n, size, raw = (sum(r[c] for r in parts_) for c in ("n", "size", "raw"))
    return Blocks(blocks.drop("file", "raw"), parts_, n, size, max((r.largest for r in parts_), default=0), raw)


def _placed_after(rows: DataFrame, counts: list[tuple[int, ...]], names: Sequence[str]) -> DataFrame:
    """rows with what all parts before theirs have of each of the names; counts: (part, its own of each)."""
    totals = np.cumsum([c[1:] for c in counts], axis=0, dtype=np.int64) - np.array([c[1:] for c in counts], np.int64)
    before = rows.sparkSession.createDataFrame([(c[0], *t) for c, t in zip(counts, totals.tolist(), strict=True)], ", ".join(["part int", *(f"{x} long" for x in names)]))
    return rows.join(F.broadcast(before), "part")


def _levels(n: int) -> list[int]:
    """Nodes of each level of a tree over n entries, the root first."""
    out = [max(1, -(-n // NODE_ITEMS))]
    while out[0] > 1:
        out.insert(0, -(-out[0] // NODE_ITEMS))
    return out


def _fields(kind: np.dtype) -> str:
    return ", ".join(f"{x} {'binary' if kind[x].kind == 'S' else 'long'}" for x in kind.names)


def _entries(table: pa.RecordBatch | pa.Table, kind: np.dtype) -> np.ndarray:
    out = np.zeros(table.num_rows, kind)
    for name in kind.names:
        column = table.column(name)
        out[name] = np.array(column.to_pylist(), kind[name]) if kind[name].kind == "S" else column.to_numpy()
    return out


def _node_bytes(x: np.ndarray, leaf: bool, size: int) -> bytes:
    return (struct.pack(NODE, leaf, 0, len(x)) + x.tobytes()).ljust(size, b"\0")


def _over(nodes: list[np.ndarray], branch: np.dtype, over, at: int, size: int) -> np.ndarray:
    """The branch entries of nodes, the first of which stands at `at`."""
    out = np.zeros(len(nodes), branch)
    for k, x in enumerate(nodes):
        over(out, k, x)
    out["offset"] = at + np.arange(len(nodes)) * size
    return out


def _nodes(entries: DataFrame, n: int, kind: np.dtype, branch: np.dtype, leaf: bool, at: int, size: int, over, folder: str) -> tuple[list[str], DataFrame]:
    """Files of the nodes of n entries (i, fields of kind), in order, and the entries (i, fields of branch) over them; tasks write them."""
    node_items = NODE_ITEMS
    schema = f"part int, file string, i long, {_fields(branch)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, name, out, node, held = TaskContext.get().partitionId(), f"nodes-{uuid.uuid4().hex}", None, None, np.zeros(0, kind)

        def put(x: np.ndarray) -> pa.RecordBatch:
            nonlocal out, node
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            nodes = [x[k : k + node_items] for k in range(0, len(x), node_items)]
            for each in nodes:
                out.write(_node_bytes(each, leaf, size))
            up = _over(nodes, branch, over, at + node * size, size)
            first, m, node = node, len(nodes), node + len(nodes)
            columns = [pa.array(up[c].tolist(), pa.binary()) if branch[c].kind == "S" else pa.array(up[c].astype(np.int64)) for c in branch.names]
            return pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([name] * m), pa.array(np.arange(first, first + m)), *columns], ["part", "file", "i", *branch.names])

        try:
            for batch in batches:
                if batch.num_rows:
                    node = batch.column("i")[0].as_py() // node_items if node is None else node  # a task has whole nodes
                    held = np.concatenate([held, _entries(batch, kind)])
                    whole = len(held) // node_items * node_items
                    if whole:
                        yield put(held[:whole])
                        held = held[whole:]
            if len(held):
                yield put(held)
        finally:
            if out is not None:
                out.close()

    dealt = entries.withColumn("node", F.expr(f"i div {node_items}")).repartitionByRange(max(1, n // DEALT), "node").sortWithinPartitions("i")
    index = f"{folder}/tree-{uuid.uuid4().hex}"
    dealt.select("i", *kind.names).mapInArrow(write, schema).write.parquet(index)
    up = entries.sparkSession.read.schema(schema).parquet(index)
    return [r.file for r in up.select("part", "file").distinct().orderBy("part").collect()], up.drop("part", "file")


def _tree(entries: DataFrame, n: int, kind: np.dtype, branch: np.dtype, at: int, over, folder: str) -> list[bytes | str]:
    """Bytes, and files of folder, that make a tree whose first byte stands at `at` over n entries (i, fields of kind).

    over(entries, k, children) makes a branch entry without its offset. Levels of many entries are the tasks' work; each is
    NODE_ITEMS times as small as the one below.
    """
    counts = _levels(n)
    sizes = [4 + NODE_ITEMS * (kind if i == len(counts) - 1 else branch).itemsize for i in range(len(counts))]
    starts = [at + sum(c * s for c, s in zip(counts[:i], sizes[:i], strict=True)) for i in range(len(counts))]
    levels: list[list[bytes | str]] = []
    now: DataFrame | np.ndarray = entries
    for i in reversed(range(len(counts))):
        leaf = i == len(counts) - 1
        mine, held = (kind if leaf else branch), (n if leaf else counts[i + 1])
        if isinstance(now, DataFrame) and held > HELD:
            files, now = _nodes(now, held, mine, branch, leaf, starts[i], sizes[i], over, folder)
            levels.insert(0, files)
            continue
        if isinstance(now, DataFrame):
            now = _entries(now.select("i", *mine.names).orderBy("i").toArrow(), mine)
        nodes = [now[k * NODE_ITEMS : (k + 1) * NODE_ITEMS] for k in range(counts[i])]
        levels.insert(0, [b"".join(_node_bytes(x, leaf, sizes[i]) for x in nodes)])
        if i:
            now = _over(nodes, branch, over, starts[i], sizes[i])
    return [x for level in levels for x in level]


def _tree_size(n: int, leaf: np.dtype, branch: np.dtype) -> int:
    counts = _levels(n)
    return sum(c * (4 + NODE_ITEMS * (leaf if i == len(counts) - 1 else branch).itemsize) for i, c in enumerate(counts))


def _span(now: np.ndarray, k: int, x: np.ndarray) -> None:
    now[k]["chrom_0"], now[k]["start"] = x[0]["chrom_0"], x[0]["start"]
    last = np.lexsort((x["end"], x["chrom_1"]))[-1]
    now[k]["chrom_1"], now[k]["end"] = x[last]["chrom_1"], x[last]["end"]


def _first_key(now: np.ndarray, k: int, x: np.ndarray) -> None:
    now[k]["key"] = x[0]["key"]


def _index(blocks: Blocks, data_at: int, at: int, folder: str) -> list[bytes | str]:
    """The R-tree at `at` over blocks whose first byte stands at data_at, in bytes and files of folder."""
    placed = _placed_after(blocks.rows, [(r.part, r.n, r["size"]) for r in blocks.parts], ["blocks_before", "bytes_before"]) if blocks.n else blocks.rows.withColumns({"blocks_before": F.lit(0), "bytes_before": F.lit(0)})
    leaves = placed.select((F.col("blocks_before") + F.col("k")).alias("i"), F.col("chrom_id").cast("long").alias("chrom_0"), "start", F.col("chrom_id").cast("long").alias("chrom_1"), "end", (F.col("bytes_before") + F.col("offset") + data_at).alias("offset"), "size")
    first, last = (blocks.parts[0].first, blocks.parts[-1].last) if blocks.n else (Row(chrom_id=0, start=0), Row(chrom_id=0))
    head = struct.pack(INDEX_HEADER, INDEX_MAGIC, NODE_ITEMS, blocks.n, first.chrom_id, first.start, last.chrom_id, max((r.end for r in blocks.parts), default=0), data_at + blocks.size, ITEMS, 0)
    return [head, *_tree(leaves, blocks.n, LEAF, BRANCH, at + len(head), _span, folder)]


def windows(rows: DataFrame, reduction: int) -> DataFrame:
    """(chrom_id, start, end, valid, least, most, total, squares): summaries of (chrom_id, size, start, end, value) by windows of `reduction` places.

    An interval counts in each window for the places that it has there.
    """
    each = rows.withColumn("w", F.explode(F.sequence(F.expr(f"start div {reduction}"), F.expr(f"(end - 1) div {reduction}"))))
    n = F.least(F.col("end"), (F.col("w") + 1) * reduction) - F.greatest(F.col("start"), F.col("w") * reduction)
    out = each.withColumn("n", n).groupBy("chrom_id", "size", "w").agg(F.sum("n").alias("valid"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.col("value") * F.col("n")).alias("total"), F.sum(F.col("value") * F.col("value") * F.col("n")).alias("squares"))
    return _placed(out, reduction)


def _placed(rows: DataFrame, reduction: int) -> DataFrame:
    start = F.col("w") * reduction
    return rows.select("chrom_id", "size", start.alias("start"), F.least(start + reduction, F.col("size")).alias("end"), "valid", "least", "most", "total", "squares")


def coarser(rows: DataFrame, reduction: int) -> DataFrame:
    """Summaries of summaries, by windows that hold theirs whole."""
    each = rows.withColumn("w", F.expr(f"start div {reduction}"))
    out = each.groupBy("chrom_id", "size", "w").agg(F.sum("valid").alias("valid"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return _placed(out, reduction)


def write_bigwig(values: DataFrame, path: str, chroms: DataFrame, reduction: int | None = None, levels: int = LEVELS, parts: int | None = None) -> None:
    """Writes values (chrom, start, end, value: half-open, without overlaps, none null) to the file at path; chroms is (chrom, size).

    Values of chromosomes that chroms does not name are an error, as are values beyond a chromosome's end or overlaps. An
    empty table gives a file without blocks. reduction is the width of the finest summaries: by default ten times the mean
    length of the values.
    """
    spark = values.sparkSession
    folder = scratch_dir(spark, "bigwig")
    known, n_chroms, key = _numbered(chroms, folder)
    rows = values.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("float").cast("double").alias("value"))
    rows = rows.join(known, "chrom", "left")
    rows.select("chrom_id", "size", *_VALUES).write.parquet(f"{folder}/values")
    rows = spark.read.schema("chrom_id int, size long, start long, end long, value double").parquet(f"{folder}/values")
    n = F.col("end") - F.col("start")
    wrong = F.col("chrom_id").isNull() | F.col("value").isNull() | F.coalesce((F.col("start") < 0) | (n <= 0) | (F.col("end") > F.col("size")), F.lit(True))
    all_ = rows.agg(F.count_if(wrong).alias("wrong"), F.count("*").alias("items"), F.sum(n).alias("covered"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.col("value") * n).alias("total"), F.sum(F.col("value") * F.col("value") * n).alias("squares")).first()
    if all_.wrong:
        raise ValueError(f"{all_.wrong} values have no chromosome, no number, or no place on it")
    items = all_.items
    parts = parts or max(spark.sparkContext.defaultParallelism, -(-items // (ITEMS * 1024)))
    data = _pack(rows, _VALUES, folder, parts)
    if items and not _apart(rows):
        raise ValueError("values overlap")
    zooms: list[tuple[int, Blocks]] = []
    if items:
        reduction = reduction or max(10, round(10 * all_.covered / items))
        now = windows(rows, reduction)
        for _ in range(levels):
            at = f"{folder}/zoom-{reduction}"
            now.write.parquet(at)
            now = spark.read.schema(now.schema).parquet(at)
            n_now = now.count()
            zooms.append((reduction, _pack(now, _SUMMARY, folder, max(1, min(parts, n_now // ITEMS)))))
            if n_now <= n_chroms:
                break
            reduction *= COARSER
            now = coarser(now, reduction)
    _assemble(path, folder, known, n_chroms, key, data, zooms, all_)


def _numbered(chroms: DataFrame, folder: str) -> tuple[DataFrame, int, int]:
    """(chrom_id, chrom, size) of chroms, numbered from 0 by name, how many they are, and the bytes of the longest name."""
    spark = chroms.sparkSession
    chroms.select("chrom", F.col("size").cast("long").alias("size")).write.parquet(f"{folder}/chroms")
    stored = spark.read.schema("chrom string, size long").parquet(f"{folder}/chroms")
    n, key = stored.agg(F.count("*"), F.max(F.octet_length("chrom"))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array(np.arange(k, k + m)), *batch.columns], ["part", "k", "chrom", "size"])
            k += m

    schema = "part int, k long, chrom string, size long"
    stored.repartitionByRange(max(1, n // DEALT), "chrom", "size").sortWithinPartitions("chrom", "size").mapInArrow(count, schema).write.parquet(f"{folder}/numbered")
    rows = spark.read.schema(schema).parquet(f"{folder}/numbered")
    counts = [(r.part, r["count"]) for r in rows.groupBy("part").count().orderBy("part").collect()]
    rows = _placed_after(rows, counts, ["before"]) if n else rows.withColumn("before", F.lit(0))
    return rows.select((F.col("before") + F.col("k")).cast("int").alias("chrom_id"), "chrom", "size"), n, key or 1


def _apart(rows: DataFrame) -> bool:
    """Whether no two values overlap, seen in slices of 100,000 places."""
    order = Window.partitionBy("chrom_id", "slice").orderBy("start")
    cut = rows.withColumn("slice", F.explode(F.sequence(F.expr("start div 100000"), F.expr("(end - 1) div 100000"))))
    return cut.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("before > start").isEmpty()


def _assemble(path: str, folder: str, known: DataFrame, n_chroms: int, key: int, data: Blocks, zooms: list[tuple[int, Blocks]], all_) -> None:
    leaf, branch = _chrom_kinds(key)
    entries = known.select(F.col("chrom_id").cast("long").alias("i"), F.encode("chrom", "utf-8").alias("key"), F.col("chrom_id").cast("long").alias("id"), "size")
    summary_at = struct.calcsize(HEADER) + len(zooms) * struct.calcsize(ZOOM_HEADER)
    chrom_at = summary_at + struct.calcsize(SUMMARY)
    head = struct.pack(CHROM_HEADER, CHROM_MAGIC, NODE_ITEMS, key, 8, n_chroms, 0)
    tree = [head, *_tree(entries, n_chroms, leaf, branch, chrom_at + len(head), _first_key, folder)]
    at = chrom_at + len(head) + _tree_size(n_chroms, leaf, branch)
    layout, raw = [], 0
    for blocks, head in [(data, 8), *((z, 4) for _, z in zooms)]:
        index_at = at + head + blocks.size
        layout.append((at, head, index_at, blocks))
        at = index_at + struct.calcsize(INDEX_HEADER) + _tree_size(blocks.n, LEAF, BRANCH)
        raw = max(raw, blocks.largest)
    source, root = FileSystem.from_uri(folder)
    store, target = FileSystem.from_uri(path)
    with store.open_output_stream(target, compression=None) as out:

        def append(pieces: Sequence[bytes | str]) -> None:
            """Bytes, and files of the tasks."""
            for x in pieces:
                if isinstance(x, bytes):
                    out.write(x)
                    continue
                with source.open_input_stream(f"{root}/{x}", compression=None) as part:
                    while piece := part.read(CHUNK):
                        out.write(piece)

        out.write(struct.pack(HEADER, MAGIC, VERSION, len(zooms), chrom_at, layout[0][0], layout[0][2], 0, 0, 0, summary_at, raw, 0))
        for (reduction, _), (data_at, _, index_at, _) in zip(zooms, layout[1:], strict=True):
            out.write(struct.pack(ZOOM_HEADER, reduction, 0, data_at, index_at))
        out.write(struct.pack(SUMMARY, all_.covered or 0, all_.least or 0.0, all_.most or 0.0, all_.total or 0.0, all_.squares or 0.0))
        append(tree)
        for k, (data_at, head, index_at, blocks) in enumerate(layout):
            n = blocks.n if k == 0 else blocks.raw // ZOOM.itemsize
            out.write(n.to_bytes(head, "little"))
            append([r.file for r in blocks.parts])
            append(_index(blocks, data_at + head, index_at, folder))


def _chrom_kinds(key: int) -> tuple[np.dtype, np.dtype]:
    """Entries of the leaves and branches of a tree of chromosomes."""
    return np.dtype([("key", f"S{key}"), ("id", "<u4"), ("size", "<u4")]), np.dtype([("key", f"S{key}"), ("offset", "<u8")])


@dataclass
class Header:
    """What a file's header says; zooms: (reduction, place of the index), and in zooms_at where each one's blocks begin."""

    key: int
    chrom_at: int
    data_at: int
    index_at: int
    zooms: list[tuple[int, int]]
    zooms_at: list[int]
    covered: int
    least: float
    most: float
    total: float


@dataclass
class Layout(Header):
    """The header with the chromosomes: name to (id, size)."""

    chroms: dict[str, tuple[int, int]]


def _read(source, at: int, n: int) -> bytes:
    return source.read_at(n, at)


def header(path: str) -> Header:
    """The header of the file at path, without its chromosomes."""
    store, target = FileSystem.from_uri(path)
    with store.open_input_file(target) as source:
        magic, version, n_zooms, chrom_at, data_at, index_at, _, _, _, summary_at, _, _ = struct.unpack(HEADER, _read(source, 0, struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError("not a bigWig file of this byte order")
        zooms = [struct.unpack(ZOOM_HEADER, _read(source, struct.calcsize(HEADER) + k * struct.calcsize(ZOOM_HEADER), struct.calcsize(ZOOM_HEADER))) for k in range(n_zooms)]
        covered, least, most, total, _ = struct.unpack(SUMMARY, _read(source, summary_at, struct.calcsize(SUMMARY))) if summary_at else (0, 0.0, 0.0, 0.0, 0.0)
        magic, _, key, _, _, _ = struct.unpack(CHROM_HEADER, _read(source, chrom_at, struct.calcsize(CHROM_HEADER)))
        if magic != CHROM_MAGIC:
            raise ValueError("no tree of chromosomes")
        return Header(key, chrom_at + struct.calcsize(CHROM_HEADER), data_at, index_at, [(z[0], z[3]) for z in zooms], [z[2] for z in zooms], covered, least, most, total)


def layout(path: str) -> Layout:
    """The header of the file at path, with all its chromosomes."""
    known = header(path)
    store, target = FileSystem.from_uri(path)
    with store.open_input_file(target) as source:
        entries, _ = _walked(source, [known.chrom_at], *_chrom_kinds(known.key))
        return Layout(**vars(known), chroms={c["key"].decode(): (int(c["id"]), int(c["size"])) for x in entries for c in x})


def _node(source, at: int, leaf: np.dtype, branch: np.dtype) -> tuple[bool, np.ndarray]:
    is_leaf, _, n = struct.unpack(NODE, _read(source, at, 4))
    kind = leaf if is_leaf else branch
    return bool(is_leaf), np.frombuffer(_read(source, at + 4, n * kind.itemsize), kind)


def _walked(source, todo: list[int], leaf: np.dtype, branch: np.dtype, wanted=None, most: int | None = None) -> tuple[list[np.ndarray], list[int]]:
    """(entries of leaves, places of nodes that are left) below the nodes at todo, level by level, while a level has `most` nodes at most; wanted(entries) tells which to follow."""
    found: list[np.ndarray] = []
    while todo and (most is None or len(todo) <= most):
        below: list[int] = []
        for at in todo:
            is_leaf, entries = _node(source, at, leaf, branch)
            if wanted is not None:
                entries = entries[wanted(entries)]
            if is_leaf:
                found.append(entries)
            else:
                below += entries["offset"].tolist()
        todo = below
    return found, todo


def _numbers(source, known: Header, names: set[str]) -> dict[str, int]:
    """The ids of those of the names that the file has; of the tree only the nodes on the way to them are read."""
    leaf, branch = _chrom_kinds(known.key)
    out = {}
    for name in names:
        at, want, is_leaf = known.chrom_at, name.encode(), False
        while not is_leaf:
            is_leaf, entries = _node(source, at, leaf, branch)
            k = int(np.searchsorted(entries["key"], np.bytes_(want), side="right")) - 1
            if k < 0:
                break
            if is_leaf:
                if entries["key"][k] == want:
                    out[name] = int(entries["id"][k])
            else:
                at = int(entries["offset"][k])
    return out


def _overlapping(regions: Sequence[tuple[int, int, int]] | None):
    """Which entries overlap one of the regions (chromosome id, start, end); None: all."""
    if regions is None:
        return None

    def wanted(entries: np.ndarray) -> np.ndarray:
        out = np.zeros(len(entries), bool)
        for chrom, start, end in regions:
            before = (entries["chrom_0"] < chrom) | ((entries["chrom_0"] == chrom) & (entries["start"] < end))
            after = (entries["chrom_1"] > chrom) | ((entries["chrom_1"] == chrom) & (entries["end"] > start))
            out |= before & after
        return out

    return wanted


def _root(source, index_at: int) -> int:
    if struct.unpack("<I", _read(source, index_at, 4))[0] != INDEX_MAGIC:
        raise ValueError("no index of blocks")
    return index_at + struct.calcsize(INDEX_HEADER)


def _in_order(found: list[np.ndarray]) -> np.ndarray:
    out = np.concatenate(found) if found else np.zeros(0, LEAF)
    return out[np.argsort(out["offset"], kind="stable")]


def overlapping_blocks(path: str, index_at: int, regions: Sequence[tuple[int, int, int]] | None) -> np.ndarray:
    """(LEAF) entries of the tree at index_at that overlap one of the regions (chromosome id, start, end); None: all. Other branches are not read."""
    store, target = FileSystem.from_uri(path)
    with store.open_input_file(target) as source:
        return _in_order(_walked(source, [_root(source, index_at)], LEAF, BRANCH, _overlapping(regions))[0])


def _below(spark: SparkSession, path: str, todo: list[int], kinds: tuple[np.dtype, np.dtype], names: Sequence[str], wanted=None) -> DataFrame:
    """(names, fields of leaves) below the nodes at todo, which tasks read."""
    leaf, branch = kinds
    schema = ", ".join(f"{x} {'binary' if leaf[x].kind == 'S' else 'long'}" for x in names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = FileSystem.from_uri(path)
        with store.open_input_file(target) as source:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    left = [at]
                    while left:  # depth first, so that few nodes are held
                        is_leaf, entries = _node(source, left.pop(), leaf, branch)
                        entries = entries if wanted is None else entries[wanted(entries)]
                        if is_leaf:
                            yield pa.RecordBatch.from_arrays([pa.array(entries[x].tolist(), pa.binary()) if leaf[x].kind == "S" else pa.array(entries[x].astype(np.int64)) for x in names], list(names))
                        else:
                            left += entries["offset"].tolist()

    return spark.createDataFrame(pa.table({"at": pa.array(todo, pa.int64())})).repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(read, schema)


def _section(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(chromosome, starts, ends, values) of a data block of any of the three kinds."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(SECTION, raw)
    body = raw[struct.calcsize(SECTION) :]
    if kind == BED_GRAPH:
        x = np.frombuffer(body, ITEM, n)
        return chrom, x["start"].astype(np.int64), x["end"].astype(np.int64), x["value"].astype(np.float64)
    if kind == VARIABLE_STEP:
        x = np.frombuffer(body, np.dtype([("start", "<u4"), ("value", "<f4")]), n)
        starts, values = x["start"].astype(np.int64), x["value"]
    elif kind == FIXED_STEP:
        starts, values = start + step * np.arange(n, dtype=np.int64), np.frombuffer(body, "<f4", n)
    else:
        raise ValueError(f"unknown kind {kind} of block")
    return chrom, starts, starts + span, values.astype(np.float64)


def _fetched(spark: SparkSession, path: str, data_at: int, index_at: int, regions: Sequence[tuple[int, int, int]] | None, make, schema: str, parts: int | None) -> DataFrame:
    """make(unpacked block) of each block from data_at on that overlaps a region (None: all), in tasks that fetch near ones together."""
    rows_most = ROWS
    wanted = _overlapping(regions)
    store, target = FileSystem.from_uri(path)
    with store.open_input_file(target) as source:
        found, todo = _walked(source, [_root(source, index_at)], LEAF, BRANCH, wanted, NODES)
    blocks = _in_order(found)
    ranges = spark.createDataFrame(pa.table({"offset": blocks["offset"].astype(np.int64), "size": blocks["size"].astype(np.int64)}))
    size, n = int(blocks["size"].sum()), len(blocks)
    if todo:  # their blocks have not been counted
        ranges = ranges.unionByName(_below(spark, path, todo, (LEAF, BRANCH), ["offset", "size"], wanted))
        size, n = index_at - data_at, max(n, len(todo))
    parts = parts or max(1, min(n, max(spark.sparkContext.defaultParallelism, size // (64 << 20))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = FileSystem.from_uri(path)
        held: list[pa.RecordBatch] = []
        n_held = 0
        with store.open_input_file(target) as source:
            for batch in batches:
                at, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                k = 0
                while k < len(at):
                    end = k + 1
                    while end < len(at) and at[end] - at[end - 1] - size[end - 1] <= GAP and at[end] + size[end] - at[k] <= CHUNK:
                        end += 1
                    raw = source.read_at(int(at[end - 1] + size[end - 1] - at[k]), int(at[k]))
                    for i in range(k, end):
                        lo = int(at[i] - at[k])
                        held.append(make(_unpacked(raw[lo : lo + int(size[i])])))
                        n_held += held[-1].num_rows
                        if n_held >= rows_most:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held, n_held = [], 0
                    k = end
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return ranges.repartitionByRange(parts, "offset").sortWithinPartitions("offset").mapInArrow(fetch, schema)


def _unpacked(raw: bytes) -> bytes:
    try:
        return zlib.decompress(raw)
    except zlib.error:  # a file may hold its blocks as they are
        return raw


def _named(spark: SparkSession, path: str, rows: DataFrame, known: Header) -> DataFrame:
    """rows with the names of their chromosomes."""
    kinds = _chrom_kinds(known.key)
    store, target = FileSystem.from_uri(path)
    with store.open_input_file(target) as source:
        found, todo = _walked(source, [known.chrom_at], *kinds, most=NODES)
    names = spark.createDataFrame([(int(c["id"]), c["key"].decode()) for x in found for c in x], "chrom_id int, chrom string")
    if not todo:
        return rows.join(F.broadcast(names), "chrom_id").drop("chrom_id")
    # Spark takes what tasks read for as small as the places that they read from, and would broadcast it.
    names = names.unionByName(_below(spark, path, todo, kinds, ["key", "id"]).select(F.col("id").cast("int").alias("chrom_id"), F.decode("key", "utf-8").alias("chrom")))
    return rows.join(names.hint("merge"), "chrom_id").drop("chrom_id")


def read_bigwig(spark: SparkSession, path: str, regions: Sequence[tuple[str, int, int]] | None = None, parts: int | None = None) -> DataFrame:
    """(chrom, start, end, value) of the file: all, or what overlaps one of the regions (chrom, start, end), read through the index alone."""
    known = header(path)
    wanted = numbers = None
    if regions is not None:
        store, target = FileSystem.from_uri(path)
        with store.open_input_file(target) as source:
            numbers = _numbers(source, known, {c for c, *_ in regions})
        wanted = [(numbers[c], s, e) for c, s, e in regions if c in numbers]

    def make(raw: bytes) -> pa.RecordBatch:
        chrom, starts, ends, values = _section(raw)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), chrom, np.int32)), pa.array(starts), pa.array(ends), pa.array(values)], ["chrom_id", "start", "end", "value"])

    rows = _fetched(spark, path, known.data_at, known.index_at, wanted, make, "chrom_id int, start long, end long, value double", parts)
    if wanted is None:
        return _named(spark, path, rows, known).select("chrom", "start", "end", "value")
    inside = F.lit(False)
    for c, s, e in wanted:
        inside = inside | ((F.col("chrom_id") == c) & (F.col("start") < e) & (F.col("end") > s))
    names = spark.createDataFrame([(k, c) for c, k in numbers.items()], "chrom_id int, chrom string")
    return rows.filter(inside).join(F.broadcast(names), "chrom_id").select("chrom", "start", "end", "value")


def read_zoom(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """(chrom, start, end, valid, least, most, total, squares): a level of summaries, 0 being the finest."""
    known = header(path)

    def make(raw: bytes) -> pa.RecordBatch:
        x = np.frombuffer(raw, ZOOM)
        return pa.RecordBatch.from_arrays([pa.array(x["chrom"].astype(np.int32)), *(pa.array(x[c].astype(np.int64 if c in ("start", "end", "valid") else np.float64)) for c in _SUMMARY)], ["chrom_id", *_SUMMARY])

    rows = _fetched(spark, path, known.zooms_at[level], known.zooms[level][1], None, make, "chrom_id int, start long, end long, valid long, least double, most double, total double, squares double", None)
    return _named(spark, path, rows, known).select("chrom", *_SUMMARY)


def error_signal(errors: DataFrame) -> DataFrame:
    """(chrom, start, end, value) of errors (chrom, position, error_type): 1 for FP, -1 for FN, at one place each; of both at a place FP stays."""
    value = F.when(F.col("error_type") == "FP", 1.0).when(F.col("error_type") == "FN", -1.0)
    rows = errors.select("chrom", F.col("position").alias("start"), value.alias("value")).filter("value is not null")
    return rows.groupBy("chrom", "start").agg(F.max("value").alias("value")).select("chrom", "start", (F.col("start") + 1).alias("end"), "value")

