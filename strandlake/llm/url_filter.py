"""URL filters: rules by host and path, and a Bloom filter cascade for a list of blocked hosts.

The cascade's first Bloom filter holds the listed keys. Over the complete universe of keys that the corpus has, it also
lets some others through; these false positives go into a second filter, the listed keys that this one lets through go
into a third, and so on until none is left. A key's answer is then exact for every key of the universe, without a join:
the first filter that refuses it tells which side it is on.

Keys are host suffixes, so a listed domain covers its subdomains. Filters are built by distributed aggregation; a long
list is cut into parts by a hash of the key, each with a cascade of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import park, table, unused

#: Listed keys of one cascade; more are dealt to several.
PART_KEYS = 4_000_000
BITS_A_KEY = 10
HASHES = 4
MOST_LEVELS = 64

# Rules as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# The domains that the query lists.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both are empty for a null and where no `://` is."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column) -> Column:
    """host and its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), key).alias("a"), F.xxhash64(F.lit(2), key).alias("b"))


def _places(a: np.ndarray, b: np.ndarray, level: int, m: int) -> list[np.ndarray]:
    """Bit numbers of keys with hashes a and b in a filter of m bits (a power of two)."""
    with np.errstate(over="ignore"):
        a, b = a.view(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15), b.view(np.uint64) | np.uint64(1)
        out = []
        for k in range(HASHES):
            x = a + np.uint64(k) * b
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(((x ^ (x >> np.uint64(29))) & np.uint64(m - 1)).astype(np.int64))
        return out


def _in(words: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    found = np.ones(len(a), bool)
    for at in _places(a, b, level, len(words) * 64):
        found &= ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return found


def _filter_of(keys: DataFrame, n: int, level: int) -> np.ndarray:
    """A Bloom filter of n keys (a, b): tasks set bits, words of 64 bits are merged by the shuffle."""
    m = max(64, 1 << (n * BITS_A_KEY - 1).bit_length())

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(m // 64, np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), level, m):
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        k = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(words[k].view(np.int64))], ["at", "word"])

    merged = keys.select("a", "b").mapInArrow(bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # the filter's own size
    words = np.zeros(m // 64, np.uint64)
    words[merged.column("at").to_numpy()] = merged.column("word").to_numpy().view(np.uint64)
    return words


def cascade(universe: DataFrame) -> list[np.ndarray]:
    """Filters for the keys (a, b, listed): exact for each of them."""
    inside, outside = universe.filter("listed").select("a", "b"), universe.filter("not listed").select("a", "b")
    levels: list[np.ndarray] = []
    while n := inside.count():
        level = len(levels)
        if level == MOST_LEVELS:
            raise ValueError("keys on both sides have the same hashes")
        words = _filter_of(inside, n, level)
        levels.append(words)

        def passes(batches: Iterator[pa.RecordBatch], words: np.ndarray = words, level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_in(words, batch.column(0).to_numpy(), batch.column(1).to_numpy(), level)))

        inside, outside = park(outside.mapInArrow(passes, "a long, b long")), inside
    return levels


def listed_in(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first filter that refuses it has the answer."""
    answer = np.zeros(len(a), bool)
    at = np.arange(len(a))
    for k, words in enumerate(levels):
        passed = _in(words, a[at], b[at], k)
        answer[at[~passed]] = k % 2 == 1
        at = at[passed]
    answer[at] = len(levels) % 2 == 1
    return answer


def build(hosts: DataFrame, listed: DataFrame, host_col: str = "host", key_col: str = "key") -> list[tuple[int, int, list[np.ndarray]]]:
    """(parts, part, cascade) for all keys of hosts: exact for each host of the table and each listed key."""
    keys = hosts.select(F.col(host_col).alias("host")).distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    known = listed.select(F.col(key_col).alias("key")).filter("key is not null and key != ''").distinct()
    both = keys.select("key", F.lit(False).alias("listed")).unionByName(known.select("key", F.lit(True).alias("listed")))
    universe = both.groupBy("key").agg(F.bool_or("listed").alias("listed")).select(_hashes(F.col("key")).alias("h"), "listed")
    universe = park(universe.select("h.a", "h.b", "listed"))
    parts = max(1, -(-universe.filter("listed").count() // PART_KEYS))
    return [(parts, p, cascade(universe.filter(F.pmod("a", F.lit(parts)) == p))) for p in range(parts)]


def is_listed(host: Column, cascades: list[tuple[int, int, list[np.ndarray]]]) -> Column:
    """Whether the host or one of its parent domains is listed."""
    keys = F.transform(suffixes(host), _hashes)

    def probe(parts: int, part: int, levels: list[np.ndarray]) -> Column:
        @F.arrow_udf("boolean")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                flat = lists.flatten()
                a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                own = a % parts == part
                hit = listed_in(levels, a[own], b[own])
                out = np.zeros(len(lists), bool)
                out[row[own][hit]] = True
                yield pa.array(out)

        return of(keys)

    return reduce(lambda x, y: x | y, [probe(*c) for c in cascades])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; a rule's verdict stands before the list's. Columns of these names are replaced, others stay.

    A null url, or one without `://`, has an empty host and path and is allowed. Rows are judged one by one, repeated ones
    alike; null and empty keys of the list count for nothing. An empty table stays empty, and so does an empty list's effect.
    """
    host, path = host_and_path(F.col(url_col))
    cascades = build(pages.select(host.alias("host")), listed)
    marked = pages.withColumns({"host": host, "path": path})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    (mark,) = unused([*marked.columns, "rule", "verdict"], "url_listed")
    marked = marked.withColumn(mark, is_listed(F.col("host"), cascades))
    return marked.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(mark), "block").otherwise("allow"))}).drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the verdict on every page's url."""
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"when (host = '{t.partition('/')[0]}' or host like '%.{t.partition('/')[0]}') and starts_with(path, '/{t.partition('/')[2]}') then '{{}}{t}'".replace("{}", f"{kind}:")
    for kind, t in sorted(RULES, key=lambda r: -len(r[1]))
)
_NAMES = ", ".join(f"'{x}'" for x in LISTED)
SQL = f"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as raw_host, rest from cut
), named as (
  select page_id, coalesce(translate(raw_host, '{_UPPER}', '{_LOWER}'), '') as host,
         coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1), '') as path from parts
), ruled as (
  select *, case {_FITS} end as fit from named
)
select page_id, host, path, substr(fit, 7) as rule,
  case when fit is not null then substr(fit, 1, 5)
       when exists (select 1 from (select unnest([{_NAMES}]) as name) where host = name or ends_with(host, '.' || name)) then 'block'
       else 'allow' end as verdict
from ruled
"""

QUERIES = {"op6_bloom_cascade": query}
ORACLES = {"op6_bloom_cascade": SQL}
