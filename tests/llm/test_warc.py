from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest
from conftest import SF_DIR, same_rows
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from strandlake.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute(rows, least):
    """Counts of (page_id, payload_bytes, digest, type, refers_to), row by row in descending order of ids."""
    out, first = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0], reverse=True):
        payload = (html or "").encode()
        known = (len(payload), hashlib.sha1(payload).hexdigest())
        if len(payload) >= least and payload in first:
            out.append((page_id, *known, "revisit", first[payload]))
        else:
            first[payload] = page_id
            out.append((page_id, *known, "response", None))
    return sorted(out, key=repr)


def test_query_equals_sql(spark, duck):
    df = warc.query(spark, SF_DIR)
    rel = duck.sql(warc.SQL)
    same_rows((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall()))


BIG = "é" * 600
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3", BIG + "x"), (4, None, None), (5, "", ""), (6, "http://a b\r\nX: y/ü", "short"), (7, "u", "short"),
    (None, "n", BIG), (None, "n", BIG + "y"), (None, "m", BIG + "y"), (9, "t", BIG + "z"), (9, "t", BIG + "z"), (9, None, BIG + "z"), (8, "t", BIG + "z"), (10, "nul", "a\x00b" * 500),
    (11, "long", "w" * 3_000_000), (12, "long", "w" * 3_000_000),
]


@pytest.mark.parametrize(("repeat", "lot"), [(1, 1000), (7, 3)])
def test_brute_force(spark, monkeypatch, repeat, lot):
    monkeypatch.setattr(warc, "LOT", lot)
    rows = ROWS * repeat
    index, folder = warc.archive(spark.createDataFrame(rows, SCHEMA), least_bytes=1000)
    assert rows_of(warc.resolve(warc.read_records(index, folder))) == brute(rows, 1000)


def test_many_groups_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "if_small", lambda df: df)
    rows = [(k, f"u{k}", "p" * (900 + k % 5 * 100)) for k in range(60)]
    index, folder = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert rows_of(warc.resolve(warc.read_records(index, folder))) == brute(rows, 1000)


def test_files_are_plain_archives(spark, monkeypatch):
    """Every archive is whole gzip members, begins with a warcinfo record and has each indexed record at its place."""
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    index, folder = warc.archive(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    root = Path(FileSystem.from_uri(folder)[1])
    at = {(r.file, r.offset): r for r in index.collect()}
    files = {p.name for p in root.iterdir()}
    assert {f for f, _ in at} == files and len(files) > 3
    n = 0
    for p in root.iterdir():
        assert gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        n += gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n")
    assert n == len(at) + len(files)
    for (file, offset), r in at.items():
        headers, block = warc.parse_record((root / file).read_bytes()[offset : offset + r.length])
        assert headers["WARC-Type"] == r.record_type and headers["WARC-Record-ID"] == f"<{r.record_id}>"
        assert block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert len({r.record_id for r in at.values()}) == len(ROWS)


def test_selected_records(spark):
    """Only what is wanted is read, with its payload."""
    rows = [(k, f"http://h/{k}", f"page {k} " * 300) for k in range(200)]
    index, folder = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(2))
    got = warc.read_records(index.filter("url in ('http://h/7', 'http://h/8', 'http://h/150')"), folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {k: rows[k][2] for k in (7, 8, 150)}
    assert warc.read_records(index.filter("page_id < 0"), folder).count() == 0
    alone = warc.resolve(warc.read_records(warc.archive(spark.createDataFrame([(1, "a", BIG), (2, "b", BIG)], SCHEMA))[0].filter("page_id = 1").limit(0), folder))
    assert alone.count() == 0


def test_revisit_without_its_response(spark):
    index, folder = warc.archive(spark.createDataFrame([(1, "a", BIG), (2, "b", BIG)], SCHEMA))
    (r,) = warc.resolve(warc.read_records(index.filter("page_id = 1"), folder)).collect()
    assert (r.record_type, r.payload_bytes, r.refers_to) == ("revisit", None, None)


def test_damage_is_seen(spark):
    index, folder = warc.archive(spark.createDataFrame([(1, "a", "one"), (2, "b", "two")], SCHEMA).coalesce(1))
    wrong = index.withColumn("url", F.lit("other"))
    with pytest.raises(Exception, match="differ"):
        warc.read_records(wrong, folder).collect()
    moved = index.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception):  # noqa: B017 - zlib's own error, inside Spark's
        warc.read_records(moved, folder).collect()


def test_coalesced_ranges():
    ranges = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 900), ("b", 0, 5), ("b", 5, 1)]
    assert list(warc.coalesced(ranges, gap=30, most=100)) == [("a", 0, 45, 3), ("a", 200, 1100, 1), ("b", 0, 6, 2)]
    assert list(warc.coalesced(ranges, gap=0, most=12)) == [("a", 0, 10, 1), ("a", 10, 15, 1), ("a", 40, 45, 1), ("a", 200, 1100, 1), ("b", 0, 6, 2)]
    assert list(warc.coalesced([])) == []


def test_other_columns_and_empty_table(spark):
    wide = spark.createDataFrame([(1, "u", BIG, 1, "x", 2), (2, "u", BIG, 1, "x", 2)], f"{SCHEMA}, `a.b` int, digest string, payload int")
    index, folder = warc.archive(wide)
    assert rows_of(warc.resolve(warc.read_records(index, folder))) == brute([(1, "u", BIG), (2, "u", BIG)], 1000)
    named = spark.createDataFrame([(1, "u", "t")], "`p.id` long, `u.l` string, `h``t` string")
    index, folder = warc.archive(named, id_col="p.id", url_col="u.l", html_col="h`t".replace("`", "``"))
    assert warc.read_records(index, folder).count() == 1
    index, folder = warc.archive(spark.createDataFrame([], SCHEMA))
    assert warc.resolve(warc.read_records(index, folder)).count() == 0
