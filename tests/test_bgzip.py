"""Block-compressed lines: any split gives the plain file's lines, and a region reads its blocks alone."""

from __future__ import annotations

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bgzip


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    """A sorted file of small blocks, some lines longer than a block and an empty one among them."""
    rng = random.Random(3)
    lines = ["##header", "#chrom\tpos"]
    for c in ("1", "2", "X"):
        at = 0
        for _ in range(400):
            at += rng.randint(0, 50)
            lines.append(f"{c}\t{at}\t" + "x" * rng.choice([0, 5, 30, 900]))
    raw = ("\n".join(lines) + "\n").encode()
    folder = tmp_path_factory.mktemp("bg")
    out, at = b"", 0
    while at < len(raw):
        n = rng.choice([1, 50, 300, 700])
        out += bgzip.make_block(raw[at : at + n])
        at += n
    (folder / "a.gz").write_bytes(out[:0] + out + bgzip.END)
    (folder / "b.gz").write_bytes(bgzip.END + bgzip.make_block(b"Y\t5\tlast line without an end"))
    (folder / "note.txt").write_text("not read")
    assert gzip.decompress((folder / "a.gz").read_bytes()) == raw
    return f"file://{folder}", lines


@pytest.mark.parametrize("split", [37, 1000, 20_000, 1 << 26])
def test_all_lines_once(spark, written, split):
    path, lines = written
    rows = bgzip.read_lines(spark, path, split)
    got = [r.line for r in rows.collect()]
    assert sorted(got) == sorted([*lines, "Y\t5\tlast line without an end"])
    assert rows.rdd.getNumPartitions() >= (10 if split <= 1000 else 2)


def test_filters_reach_the_reader(spark, written):
    path, lines = written
    got = bgzip.read_lines(spark, path, 5000).filter((F.col("chrom") == "2") & (F.col("pos") >= 100) & (F.col("pos") < 900)).select("line").collect()
    want = [x for x in lines if x.startswith("2\t") and 100 <= int(x.split("\t")[1]) < 900]
    assert sorted(r.line for r in got) == sorted(want) and want
    reader = bgzip._Reader({"path": path})
    assert len(list(reader.pushFilters([bgzip.EqualTo(("chrom",), "2"), bgzip.GreaterThan(("pos",), 7), bgzip.LessThanOrEqual(("pos",), 9)]))) == 3
    assert (reader.chrom, reader.low, reader.high) == ("2", 7, 9)


@pytest.mark.parametrize(("chrom", "start", "end"), [("1", 0, 10**9), ("2", 500, 800), ("X", 9000, 9100), ("Y", 5, 5), ("Z", 0, 9)])
def test_regions(spark, written, chrom, start, end):
    path, lines = written
    index = bgzip.block_index(spark, path, 9000)
    got = sorted(r.line for r in bgzip.read_region(spark, path, index, chrom, start, end).collect())
    assert got == sorted(x for x in [*lines, "Y\t5\tlast line without an end"] if not x.startswith("#") and x.split("\t")[0] == chrom and start <= int(x.split("\t")[1]) <= end)


def test_a_region_reads_its_blocks_alone(spark, written, tmp_path):
    """With every other block damaged, the region is still read."""
    path, lines = written
    index = spark.createDataFrame(bgzip.block_index(spark, path, 9000).collect(), bgzip.INDEX)
    raw = bytearray(Path(path.removeprefix("file://"), "a.gz").read_bytes())
    wanted = {r.block for r in index.filter("chrom = '2' and first_pos <= 800 and last_pos >= 500").collect() if r.file.endswith("a.gz")}
    at, keep = 0, max(wanted) + 60_000
    while at < len(raw):
        n = bgzip.block_size(bytes(raw[at : at + 64]))
        if at < min(wanted) or at > keep:
            raw[at + 20] ^= 0xFF
        at += n
    (tmp_path / "a.gz").write_bytes(bytes(raw))
    moved = index.withColumn("file", F.regexp_replace("file", "^.*/", f"{tmp_path}/"))
    got = bgzip.read_region(spark, f"file://{tmp_path}", moved.filter("file like '%a.gz'"), "2", 500, 800).count()
    assert got == sum(x.startswith("2\t") and 500 <= int(x.split("\t")[1]) <= 800 for x in lines) > 0
    with pytest.raises(Exception, match="damaged|invalid|error"):
        bgzip.read_lines(spark, f"file://{tmp_path}").count()


def test_write_and_read(spark, tmp_path):
    rng = random.Random(1)
    lines = [f"{k % 3}\t{k}\t{rng.random()}" for k in range(30_000)]
    frame = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string").repartition(3)
    assert bgzip.write_lines(frame, f"file://{tmp_path}/out") == 3
    back = bgzip.read_lines(spark, f"file://{tmp_path}/out", 50_000)
    assert back.rdd.getNumPartitions() > 3
    assert sorted(r.line for r in back.collect()) == sorted(lines)
    for p in Path(tmp_path, "out").iterdir():
        gzip.decompress(p.read_bytes())


def test_nothing(spark, tmp_path):
    assert bgzip.write_lines(spark.createDataFrame([], "value string"), f"file://{tmp_path}/out") == 0
    (tmp_path / "in").mkdir()
    assert bgzip.read_lines(spark, f"file://{tmp_path}/in").count() == 0
    assert bgzip.block_size(b"") is None and bgzip.block_size(b"\x1f\x8b\x08\x00" + b"\0" * 20) is None


def test_files_grow_in_number_not_in_size(spark, tmp_path):
    lines = spark.range(1000).selectExpr("concat('c\t', id) as value")
    n = bgzip.files_for(lines, each=150)
    assert (n, bgzip.files_for(lines, least=5, each=1000), bgzip.files_for(lines.limit(0))) == (7, 5, 1)
    path = f"file://{tmp_path}/many"
    assert bgzip.write_lines(lines.repartition(n), path) == 7
    assert bgzip.read_lines(spark, path).count() == 1000
