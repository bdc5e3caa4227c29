"""WARC archives with an index: records are written once, their places are kept, and selected records are read by byte ranges.

Of large equal payloads one page keeps the payload (a response), the others are revisits of it and hold headers only.
Which page that is comes from counts by payload hash; the payloads themselves are not shuffled unless there are too many
repeated ones to broadcast. Every task writes archives of its own, a gzip member for each record, and returns an index row
for each: file, offset, length, URL and digest. Spark commits the index, so a file of a lost or repeated task is never read.

Readers sort the index rows that they want by file and offset, deal them out by spans of the files, and fetch near ranges
together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import if_small, park, shared_dir, table

#: Bytes of the smallest payload that is not stored again.
LEAST_BYTES = 1000
#: An archive that has so many bytes is closed.
FILE_BYTES = 1 << 30
#: Bytes between two wanted records that are read rather than skipped, and the most that is fetched at once for several.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of records that one task reads, about.
TASK_BYTES = 64 << 20
#: Repeated rows of a page are numbered in lots of so many.
LOT = 1000

# Names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, record_type string, record_id string, file string, offset long, length long"
RECORD = f"{INDEX}, refers_id string, payload_bytes long, payload binary"


def _store(folder: str):
    """(file system, path) of a folder; loaded by the tasks that need it, as every worker holds what it has loaded."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _uri(url: str) -> str:
    """A url that fits into a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(kind: str, record_id: str, date: str, headers: dict[str, str], block: bytes, content_type: str = "application/http; msgtype=response") -> bytes:
    """One record as a gzip member."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **headers, "Content-Type": content_type, "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a gzip member, which must hold one whole record."""
    unpacker = zlib.decompressobj(31)
    raw = unpacker.decompress(member) + unpacker.flush()
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not unpacker.eof or unpacker.unused_data or lines[0] != VERSION:
        raise ValueError("not a record")
    headers = dict(x.decode().split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def _labelled(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _sha1_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def with_verdicts(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, key, response, grouped) for each row of pages.

    payload is null where the row is a revisit. A null page_id counts as smaller than any other. Of rows that share payload
    and page_id the one with the smallest url (null first) can be the response, of rows that share all three any one.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha2("payload", 256)).alias("key"))
    large = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("key", "page_id").agg(F.count("*").alias("n"))
    groups = large.groupBy("key").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).filter("n > 1")
    groups = park(groups.select("key", F.col("top.page_id").alias("top_id"), (F.col("top.n") > 1).alias("tied"), F.lit(True).alias("grouped")))
    marked = rows.join(if_small(groups), "key", "left").withColumn("grouped", F.coalesce("grouped", F.lit(False)))
    top = F.col("grouped") & F.col("page_id").eqNullSafe(F.col("top_id"))
    marked = marked.withColumn("response", ~F.col("grouped") | top)
    columns = ["page_id", "url", F.when(F.col("response"), F.col("payload")).alias("payload"), "digest", "payload_bytes", "key", "response", "grouped"]
    if groups.filter("tied").isEmpty():
        return marked.select(*columns)
    tied = marked.filter("grouped and tied and response")
    names = ["page_id", "digest", "payload_bytes", "key"]
    kept = tied.groupBy(*names).agg(F.min(F.struct(F.col("url").isNotNull(), "url", "payload")).alias("first"))
    kept = kept.select("page_id", "first.url", "first.payload", "digest", "payload_bytes", "key", F.lit(True).alias("response"), F.lit(True).alias("grouped"))
    same = tied.groupBy(*names, "url").agg(F.count("*").alias("n"))
    least = same.groupBy("key").agg(F.min(F.struct(F.col("url").isNotNull(), "url")).alias("first"))
    again = same.join(least, "key").withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("first.url")).cast("long")).filter("n > 0")
    lots = again.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {LOT}")))).repartition("key", "url", "lot")
    lots = lots.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT).cast("int"))))
    more = lots.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "payload_bytes", "key", F.lit(False).alias("response"), F.lit(True).alias("grouped"))
    return marked.filter("not (grouped and tied and response)").select(*columns).unionByName(kept).unionByName(more)


def write_archives(rows: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """The index (INDEX) of a record for each of `rows` (as from with_verdicts), written to archives below folder.

    An archive begins with a warcinfo record, which the index leaves out. The folder must be one that all tasks reach and
    that Arrow's file systems can open.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        try:
            for batch in batches:
                found = []
                for r in batch.to_pylist():
                    if out is None:
                        name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                        info = make_record("warcinfo", uuid.uuid4().urn, date, {"WARC-Filename": name}, b"format: WARC File Format 1.1\r\n", "application/warc-fields")
                        out.write(info)
                        at += len(info)
                    group = uuid.UUID(bytes=r["key"][:16], version=4).urn
                    kind = "response" if r["response"] else "revisit"
                    record_id = group if r["response"] and r["grouped"] else uuid.uuid4().urn
                    headers = {} if r["url"] is None else {"WARC-Target-URI": _uri(r["url"])}
                    headers |= {} if r["page_id"] is None else {"WARC-Page-ID": str(r["page_id"])}
                    headers["WARC-Payload-Digest"] = _labelled(r["digest"])
                    if kind == "revisit":
                        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{group}>"}
                    member = make_record(kind, record_id, date, headers, _http(r["payload_bytes"]) + (r["payload"] or b""))
                    out.write(member)
                    found.append((r["page_id"], r["url"], r["digest"], kind, record_id, name, at, len(member)))
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                yield _batch(found)
        finally:
            if out is not None:
                out.close()

    return park(rows.select("page_id", "url", "payload", "digest", "payload_bytes", "key", "response", "grouped").mapInArrow(write, INDEX))


_KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    m = len(rows[0]) if rows else 8
    columns = zip(*rows, strict=True) if rows else [[]] * m
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _KINDS[:m], strict=True)], _NAMES[:m])


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = SPAN) -> Iterator[tuple[str, int, int, int]]:
    """(file, start, end, how many) of the reads for (file, offset, length), sorted: near ranges of a file are read together, up to `most` bytes."""
    name, start, end, n = None, 0, 0, 0
    for file, offset, length in ranges:
        if n and file == name and offset - end <= gap and max(end, offset + length) - start <= most:
            end, n = max(end, offset + length), n + 1
            continue
        if n:
            yield name, start, end, n
        name, start, end, n = file, offset, offset + length, 1
    if n:
        yield name, start, end, n


def read_records(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP) -> DataFrame:
    """The records (RECORD) of the given index rows, whatever the index was filtered by.

    The payload's digest and length are checked against headers and index; a difference is an error. Without `payloads`
    they are left out after that. A revisit has no payload and no length of its own, and the id of its response.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            for file, start, end, n in coalesced(((r["file"], r["offset"], r["length"]) for r in rows), gap):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                raw = memoryview(source.read_at(end - start, start))
                found = []
                for r in rows[at : at + n]:
                    lo = r["offset"] - start
                    headers, block = parse_record(raw[lo : lo + r["length"]])
                    found.append(_checked(r, headers, block, payloads))
                at += n
                yield _batch(found)
        if source is not None:
            source.close()

    spans = index.select(*_NAMES[:8]).repartition(parts, "file", F.expr(f"offset div {SPAN}")).sortWithinPartitions("file", "offset")
    return spans.mapInArrow(read, RECORD)


def _checked(r: dict, headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, digest = headers["WARC-Type"], _sha1_hex(headers["WARC-Payload-Digest"])
    page_id = int(headers["WARC-Page-ID"]) if "WARC-Page-ID" in headers else None
    url = None if r["url"] is None else _uri(r["url"])
    if (kind, digest, page_id, headers["WARC-Record-ID"], headers.get("WARC-Target-URI")) != (r["record_type"], r["digest"], r["page_id"], f"<{r['record_id']}>", url):
        raise ValueError(f"the index and the record at {r['file']}:{r['offset']} differ")
    payload, n, refers = None, None, None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        n = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload at {r['file']}:{r['offset']} is damaged")
    else:
        refers = headers["WARC-Refers-To"][1:-1]
    return (page_id, r["url"], digest, kind, r["record_id"], r["file"], r["offset"], r["length"], refers, n, payload if payloads else None)


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits with the length and page of their response.

    A revisit whose response is not among the records has a null length.
    """
    rows = park(records.select("page_id", "payload_bytes", "digest", "record_type", "record_id", "refers_id"))
    wanted = rows.filter("record_type = 'revisit'").select(F.col("refers_id").alias("record_id")).distinct()
    to = rows.filter("record_type = 'response'").join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"))
    own = rows.filter("record_type = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.filter("record_type = 'revisit'").join(if_small(park(to)), "refers_id", "left")
    return own.unionByName(again.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """(index, folder) of archives with a record for each row of pages, in a folder of the shared one by default.

    A null html is an empty payload, a null url a record without one, a null page_id the smallest. Every row has a record,
    repeated ones too. An empty table has no archives. Other columns of pages are not used.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write_archives(with_verdicts(pages, least_bytes, id_col, url_col, html_col), folder), folder


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: what the archives of `pages` say of each page, read back whole."""
    index, folder = archive(table(spark, sf_dir, "pages"))
    return resolve(read_records(index, folder, payloads=False))


SQL = f"""
with rows as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), placed as (
  select *, octet_length(payload) >= {LEAST_BYTES} as large, first_value(page_id) over w as top, row_number() over w as k
  from rows window w as (partition by payload order by page_id desc nulls last)
)
select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest,
  case when large and k > 1 then 'revisit' else 'response' end as record_type, case when large and k > 1 then top end as refers_to
from placed
"""

QUERIES = {"op11_warc_index": query}
ORACLES = {"op11_warc_index": SQL}
