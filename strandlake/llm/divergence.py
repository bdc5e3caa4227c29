"""Source divergence audit: how far the sources of a language differ in their terms, pair by pair, and by which terms.

Terms are counted where the documents lie, by DuckDB over slices of text; their counts go to shards by a hash of language
and term, where DuckDB merges them and keeps the terms that enough documents have. Spark adds up the sizes of all groups.
In a second pass each shard has its kept terms and its language's groups, and DuckDB gives partial sums of the pairs and
the best terms of the shard; Spark merges the sums and ranks them. All numbers are whole.

A pair's sum runs over all kept terms, also those that neither source has. With p0 for the value of an absent term it is

    sum over i's terms of |p_i - p0_j|  +  sum over j's terms of |p_j - p0_i|  +  (V - terms of i - terms of j) |p0_i - p0_j|
    + sum over common terms of (|p_i - p_j| - |p_i - p0_j| - |p_j - p0_i| + |p0_i - p0_j|)

so a shard pairs only sources that share a term, and meets the others by the few different values of p.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import chunks, park, table, text_buffer
from .duck import ask, connect, whole_runs

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCS = 30
#: Terms reported of each group.
TOP = 50
#: Added to each count.
PRIOR = 5
SCALE = 1_000_000_000
#: Bytes of text that one statement counts, and counts that a task gathers before it sends them on.
SLICE_BYTES = 4 << 20
HELD = 500_000
#: Rows of counts that one statement merges, and kept counts of one shard, about.
MERGED = 100_000
SHARD_ROWS = 200_000

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COUNTS = "lang string, source string, term string, n long, d long"
_COUNT_SQL = f"""
select lang, source, term, cast(sum(n) as bigint) as n, count(*) as d from (
  select doc, lang, source, term, count(*) as n
  from (select doc, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) as term from docs)
  group by doc, lang, source, term)
group by lang, source, term
"""
_ADD_SQL = "select lang, source, term, cast(sum(n) as bigint) as n, cast(sum(d) as bigint) as d from counts group by lang, source, term"


def _add(con, parts: list[pa.Table]) -> pa.Table:
    return ask(con, _ADD_SQL, counts=pa.concat_tables(parts))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) of docs (text, lang, source): occurrences and documents, as summed up as a task can hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, parts, fresh = connect(), [], 0
        for batch in batches:
            _, offsets = text_buffer(batch.column(0))
            for lo, hi in chunks(offsets, SLICE_BYTES):
                part = batch.slice(lo, hi - lo).append_column("doc", pa.array(range(hi - lo), pa.int64()))
                parts.append(ask(con, _COUNT_SQL, docs=part))
                fresh += parts[-1].num_rows
                if fresh > HELD:
                    parts, fresh = [_add(con, parts)], 0
                    if parts[0].num_rows > HELD:
                        yield from parts[0].to_batches()
                        parts = []
        if parts:
            yield from _add(con, parts).to_batches()

    return docs.mapInArrow(count, _COUNTS)


_KEPT = "lang string, term string, source string, n long, lang_n long, first boolean"


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n, first): counts of terms that least_docs documents of the language have; first marks one row of each term."""
    sql = f"""
    select lang, term, source, n, cast(sum(n) over w as bigint) as lang_n, row_number() over (partition by lang, term order by source) = 1 as first
    from ({_ADD_SQL}) window w as (partition by lang, term) qualify sum(d) over w >= {int(least_docs)}
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for rows in whole_runs(batches, ["lang", "term"], MERGED, lambda run: _add(con, [run])):
            yield from ask(con, sql, counts=rows).to_batches()

    return counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, _KEPT)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n_group, terms, n_lang, v): one row for each group of docs, also without kept terms."""
    groups = docs.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("terms"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = groups.join(own, ["lang", "source"], "left").fillna(0, ["n_group", "terms", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("firsts").alias("v"))
    return groups.join(langs, "lang").drop("firsts")


def _p(n: str, total: str) -> str:
    return f"1 + cast({SCALE}::hugeint * ({n} + {PRIOR}) // ({total} + {PRIOR}::hugeint * v) as bigint)"


_CELLS_SQL = f"select term, source, {_p('n', 'n_group')} as p, {_p('0', 'n_group')} as p0, {_p('lang_n', 'n_lang')} as q from rows"
_GROUPS_SQL = f"select source, {_p('0', 'n_group')} as p0 from rows"
#: Sums over the common terms of two sources, and over one's terms where the other has none.
_PAIRS_SQL = """
select a, b, cast(sum(value) as bigint) as value from (
  select i.source as a, j.source as b, sum(abs(i.p - j.p) - abs(i.p - j.p0) - abs(j.p - i.p0) + abs(i.p0 - j.p0)) as value
  from cells i join cells j on i.term = j.term and i.source < j.source group by 1, 2
  union all
  select least(i.source, j.source), greatest(i.source, j.source), sum(i.n * abs(i.p - j.p0))
  from (select source, p, count(*) as n from cells group by 1, 2) i join everyone j on i.source <> j.source group by 1, 2)
group by a, b
"""
_MERGE_SQL = "select a, b, cast(sum(value) as bigint) as value from parts group by a, b"
_FOUND = "lang string, source string, part string, item string, value long"


def shard_sums(kept: DataFrame, groups: DataFrame, top: int = TOP, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value) of each shard: partial sums of pairs (source before item), and the best terms of its groups."""
    if shards is None:
        shards = max(1, -(-kept.count() // SHARD_ROWS))
    numbers = groups.join(groups.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")), "lang")
    numbers = numbers.filter("v > 0").select("lang", "shard", F.lit(None).cast("string").alias("term"), "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), "n_group", "n_lang", "v")
    rows = kept.withColumn("shard", F.pmod(F.xxhash64(F.lit(13), "term"), F.lit(shards)).cast("int")).join(groups.drop("terms"), ["lang", "source"])
    rows = numbers.unionByName(rows.drop("first"))
    best = "select source, term, value from {} qualify row_number() over (partition by source order by value desc, term) <= " + str(int(top))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        unit, everyone, pairs, terms = None, None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            """What the unit has found."""
            for part, found in (("pair", pairs), ("term", terms)):
                if found:
                    rows = ask(con, _MERGE_SQL if part == "pair" else best.format("parts"), parts=pa.concat_tables(found))
                    same = [pa.array([x] * rows.num_rows, pa.string()) for x in (unit[0], part)]
                    yield from pa.table([same[0], rows.column(0), same[1], rows.column(1), rows.column(2)], ["lang", "source", "part", "item", "value"]).to_batches()

        for many in whole_runs(batches, ["lang", "shard", "term"], MERGED):
            for rows in _by_unit(many):
                now = (rows.column("lang")[0].as_py(), rows.column("shard")[0].as_py())
                if now != unit:
                    yield from out()
                    unit, everyone, pairs, terms = now, None, [], []
                head = rows.filter(pc.is_null(rows.column("term")))
                if head.num_rows:
                    found = ask(con, _GROUPS_SQL, rows=head)
                    everyone = found if everyone is None else pa.concat_tables([everyone, found])
                body = rows.filter(pc.is_valid(rows.column("term")))
                if body.num_rows:
                    cells = ask(con, _CELLS_SQL, rows=body)
                    pairs.append(ask(con, _PAIRS_SQL, cells=cells, everyone=everyone))
                    terms.append(ask(con, best.format("(select source, term, p - q as value from cells where p > q)"), cells=cells))
        yield from out()

    return rows.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term").mapInArrow(sums, _FOUND)


def _by_unit(rows: pa.Table) -> Iterator[pa.Table]:
    """The rows of each (lang, shard), in order."""
    lang, shard = rows.column("lang").combine_chunks(), rows.column("shard").combine_chunks()
    n = rows.num_rows
    change = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(shard.slice(1), shard.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    at = [0, *(change.nonzero()[0] + 1).tolist(), n]
    for lo, hi in zip(at, at[1:], strict=False):
        yield rows.slice(lo, hi - lo)


def _absent() -> Column:
    """The value of a kept term that a group does not have."""
    return F.expr(f"1 + cast({SCALE * PRIOR} as decimal(38, 0)) div (cast(n_group as decimal(37, 0)) + {PRIOR} * cast(v as decimal(36, 0)))")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of docs.

    Part `pair` has each other source of the language with the summed distance of the two over all kept terms, part `term`
    the `top` terms that are likelier in the group than in the language. A null text, lang or source is empty; each row
    counts as a document, repeated ones too; a group without terms, or of a language without kept terms, has its pairs
    (value 0 where no term is kept). Ties are ranked by the item's bytes. Other columns are not used; an empty table gives
    no rows.
    """

    def text(name: str, alias: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(alias)

    rows = docs.select(text(text_col, "text"), text(lang_col, "lang"), text(source_col, "source"))
    kept = park(kept_terms(term_counts(rows), least_docs))
    groups = park(group_sizes(rows, kept))
    found = park(shard_sums(kept, groups, top))
    base = groups.filter("v > 0").select("lang", "source", "terms", "v", _absent().alias("p0"))
    other = base.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("item_p0"))
    none = (F.col("v") - F.col("terms") - F.col("item_terms")) * F.abs(F.col("p0") - F.col("item_p0"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    absent = base.join(other, "lang").filter("source < item").select("lang", "source", "item", none.cast("long").alias("value"))
    sums = found.filter("part = 'pair'").select("lang", "source", "item", "value").unionByName(absent).unionByName(every)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    ranked = both.unionByName(found.filter("part = 'term'")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: divergence of all sources of `documents`."""
    return divergence(table(spark, sf_dir, "documents"))


SQL = f"""
with docs as (
  select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), terms as (
  select doc, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) as term from docs
), vocabulary as (
  select lang, term, count(*) as lang_n from terms group by lang, term having count(distinct doc) >= {LEAST_DOCS}
), groups as (
  select distinct lang, source from docs
), counted as (
  select lang, source, term, count(*) as n from terms group by all
), grid as (
  select g.lang, g.source, v.term, coalesce(c.n, 0) as n, v.lang_n
  from groups g join vocabulary v on g.lang = v.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = v.term
), sized as (
  select *, sum(n) over (partition by lang, source) as total, count(*) over (partition by lang, source) as v, sum(lang_n) over (partition by lang, source) as lang_total from grid
), valued as (
  select lang, source, term, n, 1 + cast({SCALE}::hugeint * (n + {PRIOR}) // (total + {PRIOR} * v) as bigint) as p,
    1 + cast({SCALE}::hugeint * (lang_n + {PRIOR}) // (lang_total + {PRIOR} * v) as bigint) as q from sized
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(any_value(s.value), 0) as bigint) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from valued x join valued y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source
  group by all
), found as (
  select * from pairs union all select lang, source, 'term', term, p - q from valued where n > 0 and p > q
)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from found qualify part = 'pair' or rank <= {TOP}
"""

QUERIES = {"op13_source_divergence": query}
ORACLES = {"op13_source_divergence": SQL}
