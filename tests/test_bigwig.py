"""bigWig files: round trips, regions, summaries by brute force, and the bytes themselves."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandlake.sources import bigwig as bw

SCHEMA = "chrom string, start long, end long, value double"


def made(seed, n, chroms=("chr1", "chr10", "chr2", "chrM")):
    rng = random.Random(seed)
    sizes, rows = {}, []
    for c in chroms:
        at = rng.randint(0, 5)
        for _ in range(rng.randint(1, n)):
            end = at + rng.choice([1, 1, 2, 40, 700])
            rows.append((c, at, end, rng.choice([0.5, -1.0, 3.25, 0.0, 100.0])))
            at = end + rng.choice([0, 0, 1, 90])
        sizes[c] = at + rng.randint(0, 10)
    rng.shuffle(rows)
    return rows, sizes


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A file of many small blocks and deep trees."""
    old = bw.ITEMS, bw.NODE_ITEMS
    bw.ITEMS, bw.NODE_ITEMS = 8, 3
    try:
        rows, sizes = made(1, 400)
        path = f"file://{tmp_path_factory.mktemp('bw')}/a.bw"
        bw.write_bigwig(spark.createDataFrame(rows, SCHEMA).repartition(5), path, spark.createDataFrame([*sizes.items(), ("unused", 7)], "chrom string, size long"), reduction=30, levels=3, parts=6)
        yield path, rows, sizes
    finally:
        bw.ITEMS, bw.NODE_ITEMS = old


def test_round_trip(spark, written):
    path, rows, _ = written
    assert sorted(tuple(r) for r in bw.read_bigwig(spark, path, parts=3).collect()) == sorted(rows)


@pytest.mark.parametrize("regions", [[("chr1", 0, 50)], [("chr2", 3000, 3001), ("chr10", 0, 10**9)], [("nowhere", 0, 9)], []])
def test_regions(spark, written, regions):
    path, rows, _ = written
    want = sorted(r for r in rows if any(r[0] == c and r[1] < e and r[2] > s for c, s, e in regions))
    assert sorted(tuple(r) for r in bw.read_bigwig(spark, path, regions).collect()) == want


def test_the_index_prunes(written):
    path, rows, _ = written
    known = bw.layout(path)
    every = bw.overlapping_blocks(path, known.index_at, None)
    k = known.chroms["chr1"][0]
    own = sorted(r for r in rows if r[0] == "chr1")
    few = bw.overlapping_blocks(path, known.index_at, [(k, own[0][1], own[0][2])])
    assert len(every) >= len(rows) // 8 and len(few) == 1


def test_summaries(spark, written):
    path, rows, sizes = written
    known = bw.layout(path)
    assert [r for r, _ in known.zooms] == [30, 120, 480]
    for level, (width, _) in enumerate(known.zooms):
        want = defaultdict(list)
        for c, s, e, x in rows:
            for p in range(s, e):
                want[c, p // width].append(x)
        got = {(r.chrom, r.start // width): r for r in bw.read_zoom(spark, path, level).collect()}
        assert set(got) == set(want)
        for (c, w), xs in want.items():
            r = got[c, w]
            assert (r.start, r.end, r.valid, r.least, r.most) == (w * width, min((w + 1) * width, sizes[c]), len(xs), min(xs), max(xs))
            assert r.total == pytest.approx(sum(xs), rel=1e-6) and r.squares == pytest.approx(sum(x * x for x in xs), rel=1e-6)
    n = sum(e - s for _, s, e, _ in rows)
    assert (known.covered, known.least, known.most) == (n, -1.0, 100.0)
    assert known.total == pytest.approx(sum((e - s) * x for _, s, e, x in rows))


def test_bytes(written):
    """The file read by its layout alone: where the header points to, every block, and the leaves of the index in order."""
    path, rows, sizes = written
    raw = open(path.removeprefix("file://"), "rb").read()
    magic, version, n_zooms, chrom_at, data_at, index_at, fields, defined, sql, summary_at, most, more = struct.unpack_from("<IHHQQQHHQQIQ", raw)
    assert (magic, version, n_zooms, fields, defined, sql, more) == (0x888FFC26, 4, 3, 0, 0, 0, 0)
    assert summary_at == 64 + 24 * 3 and chrom_at == summary_at + 40
    (n_blocks,) = struct.unpack_from("<Q", raw, data_at)
    magic, per_node, n, c0, s0, c1, e1, end, per_block, _ = struct.unpack_from("<IIQIIIIQII", raw, index_at)
    assert (magic, n, end, per_block) == (0x2468ACE0, n_blocks, index_at, 8)

    def leaves(at):
        leaf, _, m = struct.unpack_from("<BBH", raw, at)
        assert m <= per_node
        for k in range(m):
            if leaf:
                yield struct.unpack_from("<IIIIQQ", raw, at + 4 + 32 * k)
            else:
                yield from leaves(struct.unpack_from("<IIIIQ", raw, at + 4 + 24 * k)[4])

    found, at, before = [], data_at + 8, (-1, -1)
    for chrom, start, chrom_1, stop, offset, size in leaves(index_at + 48):
        assert offset == at and chrom == chrom_1 and (chrom, start) > before
        at, before = at + size, (chrom, start)
        block = zlib.decompress(raw[offset : offset + size])
        assert len(block) <= most
        c, s, e, _, _, kind, _, m = struct.unpack_from("<IIIIIBBH", block)
        assert (c, s, e, kind, len(block)) == (chrom, start, stop, 1, 24 + 12 * m)
        found += [(sorted([*sizes, "unused"])[c], *struct.unpack_from("<IIf", block, 24 + 12 * k)) for k in range(m)]
    assert at == index_at and found == sorted(rows)


def test_other_kinds_of_blocks():
    head = lambda kind, n, step=0, span=1: struct.pack("<IIIIIBBH", 2, 10, 99, step, span, kind, 0, n)
    chrom, s, e, x = bw._section(head(2, 2, span=5) + struct.pack("<IfIf", 10, 1.5, 30, 2.5))
    assert (chrom, s.tolist(), e.tolist(), x.tolist()) == (2, [10, 30], [15, 35], [1.5, 2.5])
    _, s, e, x = bw._section(head(3, 3, step=10, span=4) + struct.pack("<fff", 1, 2, 3))
    assert (s.tolist(), e.tolist(), x.tolist()) == ([10, 20, 30], [14, 24, 34], [1, 2, 3])
    with pytest.raises(ValueError, match="unknown kind"):
        bw._section(head(9, 0))


@pytest.mark.parametrize(("row", "what"), [(("chr1", 5, 9, 1.0), "overlap"), (("chrZ", 0, 1, 1.0), "no chromosome"), (("chr1", 90, 101, 1.0), "no place"), (("chr1", 50, 50, 1.0), "no place"), (("chr1", -1, 1, 1.0), "no place"), (("chr1", 50, 51, None), "no number"), (("chr1", None, 51, 1.0), "no place")])
def test_wrong_values(spark, tmp_path, row, what):
    values = spark.createDataFrame([("chr1", 0, 6, 1.0), ("chr1", 20, 30, 1.0), row], SCHEMA)
    with pytest.raises(ValueError, match="overlap" if what == "overlap" else "no chromosome, no number, or no place"):
        bw.write_bigwig(values, f"file://{tmp_path}/x.bw", spark.createDataFrame([("chr1", 100)], "chrom string, size long"))


def test_empty_and_errors(spark, tmp_path):
    path = f"file://{tmp_path}/e.bw"
    bw.write_bigwig(spark.createDataFrame([], SCHEMA), path, spark.createDataFrame([("c", 5)], "chrom string, size long"))
    assert bw.read_bigwig(spark, path).count() == 0 and bw.layout(path).zooms == []
    errors = spark.createDataFrame([("c", 3, "FP"), ("c", 3, "FN"), ("c", 4, "FN"), ("c", 1, "TP")], "chrom string, position long, error_type string")
    bw.write_bigwig(bw.error_signal(errors), path, spark.createDataFrame([("c", 5)], "chrom string, size long"))
    assert sorted(tuple(r) for r in bw.read_bigwig(spark, path).collect()) == [("c", 3, 4, 1.0), ("c", 4, 5, -1.0)]
    (tmp_path / "no.bw").write_bytes(b"\0" * 80)
    with pytest.raises(ValueError, match="not a bigWig"):
        bw.layout(f"file://{tmp_path}/no.bw")
    assert np.dtype(bw.LEAF).itemsize == 32 and np.dtype(bw.ZOOM).itemsize == 32


def test_blocks_come_to_the_driver_in_few_bytes(spark, tmp_path):
    """A block for each chromosome: what tasks send of it is its size, chromosome and span, not its file's name."""
    rows = spark.range(20_000).selectExpr("concat('c', id) as chrom", "4000000000L + id as start", "4000000001L + id as end", "1D as value")
    sizes = rows.selectExpr("chrom", "4200000000L as size")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def sent():
        found = store.stageList(None, False, False, none, None)
        return sum(found.apply(k).resultSize() for k in range(found.size()))

    before, path = sent(), f"file://{tmp_path}/many.bw"
    bw.write_bigwig(rows, path, sizes, reduction=1000, levels=1)
    got = sent() - before
    assert got < 3_000_000, got
    assert bw.read_bigwig(spark, path, [("c77", 0, 2**32 - 1)]).collect() == [("c77", 4_000_000_077, 4_000_000_078, 1.0)]


def test_trees_of_tasks(spark, written, tmp_path, monkeypatch):
    """Trees that tasks pack and walk are byte for byte those of the driver."""
    _, rows, sizes = written
    sizes = sizes | {f"more{k}": 9 for k in range(40)}
    frames = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*sizes.items()], "chrom string, size long")
    files = []
    for held, dealt in ((10**6, 10**6), (4, 20)):
        monkeypatch.setattr(bw, "HELD", held)
        monkeypatch.setattr(bw, "DEALT", dealt)
        bw.write_bigwig(frames[0], f"file://{tmp_path}/{held}.bw", frames[1], reduction=30, levels=2, parts=1)
        files.append((tmp_path / f"{held}.bw").read_bytes())
    assert files[0] == files[1]
    monkeypatch.setattr(bw, "NODES", 2)
    path = f"file://{tmp_path}/4.bw"
    assert sorted(tuple(r) for r in bw.read_bigwig(spark, path).collect()) == sorted(rows)
    regions = [("chr2", 100, 3000), ("more7", 0, 9), ("chrM", 0, 10**9), ("chr3", 0, 10**9), ("a", 0, 5), ("z", 0, 5)]
    want = sorted(r for r in rows if any(r[0] == c and r[1] < e and r[2] > s for c, s, e in regions))
    assert sorted(tuple(r) for r in bw.read_bigwig(spark, path, regions).collect()) == want
    known = bw.layout(path)
    assert {c: s for c, (_, s) in known.chroms.items()} == sizes and sorted(known.chroms) == sorted(known.chroms, key=lambda c: known.chroms[c][0])
    assert sum(r.valid for r in bw.read_zoom(spark, path, 1).collect()) == sum(e - s for _, s, e, _ in rows)


def test_the_driver_gets_neither_chromosomes_nor_blocks(spark, tmp_path, monkeypatch):
    """Of a file with many chromosomes, tasks send rows of tasks and of upper levels, to write and to read it."""
    monkeypatch.setattr(bw, "ITEMS", 1024)
    monkeypatch.setattr(bw, "NODE_ITEMS", 256)
    rows = spark.range(30_000).selectExpr("concat('c', id) as chrom", "id as start", "id + 1 as end", "1D as value")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def sent():
        found = store.stageList(None, False, False, none, None)
        return sum(max(0, found.apply(k).resultSize() - 8_000 * found.apply(k).numTasks()) for k in range(found.size()))

    before, path, small = sent(), f"file://{tmp_path}/many.bw", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # what Spark itself may send to the driver for a join
    try:
        bw.write_bigwig(rows, path, rows.selectExpr("chrom", "40000L as size"), reduction=1000, levels=1)
        n, total = bw.read_bigwig(spark, path).selectExpr("count(distinct chrom)", "sum(start)").first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert (n, total) == (30_000, 30_000 * 29_999 // 2) and sent() - before < 150_000, sent() - before


def test_summaries_of_many_chromosomes_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Names that tasks read are joined by a shuffle: what tasks read for has no size beforehand that could be trusted."""
    for name, value in (("NODE_ITEMS", 8), ("HELD", 50), ("NODES", 4)):
        monkeypatch.setattr(bw, name, value)
    rows = spark.range(600).selectExpr("concat('c', id) as chrom", "id as start", "id + 1 as end", "cast(id as double) as value")
    path = f"file://{tmp_path}/many.bw"
    bw.write_bigwig(rows, path, rows.selectExpr("chrom", "1000L as size"), reduction=100, levels=1)
    zoom = bw.read_zoom(spark, path)
    plan = zoom._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.chrom, r.start, r.end, r.valid, r.total) for r in zoom.collect()) == sorted((f"c{k}", k // 100 * 100, k // 100 * 100 + 100, 1, float(k)) for k in range(600))
