"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies of each of its documents, say 1.37: one copy for certain, and
another with probability 0.37. Two such fractions meet; words move from one document to the other, in a random direction
that keeps both expectations, until one of the fractions is 0 or 1. That document is decided, the other one goes on. The
sum of words does not change, so a source misses its target by less than one document. Groups of about `FAN` documents
are folded so in parallel, their leftovers are folded in groups again, and so on: a reduction tree of log(n) / log(FAN)
levels, whatever share of the rows a source holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import park, table, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most copies of a document.
MOST = 3
FAN = 64
SEED = 20240229


def word_count(text: Column) -> Column:
    """Runs outside ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, units, target) from (source, size, units): one row for each source.

    Targets share the sum of all sizes by weight; one that would pass `most` times its source's size stops there, and the
    others share the rest by weight. With the sources by cap over weight, those that stop come first.
    """
    first = Window.orderBy(F.col("source").isNull(), "source")
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(0))
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("units").alias("units"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(first) - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size").cast("double") * most)
    out = out.withColumns({"total": F.sum("source_size").over(all_).cast("double"), "all_weight": F.sum("weight").over(all_)})
    out = out.withColumns({"rest": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "rest_weight": F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    out = out.withColumn("stops", F.col("cap") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    # Of the sources that don't stop, the first one's share of the rest is everyone's.
    shared = F.max(F.when(~F.col("stops"), F.struct((-F.col("cap") / F.col("weight")).alias("k"), (F.col("rest") / F.col("rest_weight")).alias("v")))).over(all_)["v"]
    out = out.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(shared * F.col("weight")))
    return out.select("source", "source_size", "units", "target")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from its parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def _fold(units: Column, seed: int) -> Column:
    """struct(open, done): the fold of an array of (h, doc_id, base, size, mass), where mass of size is to be taken.

    `open` is the unit that is left, `done` has the others with their 0 or 1 in `extra`.
    """
    unit = "struct<real:boolean,h:bigint,doc_id:bigint,base:int,size:bigint,mass:double>"
    none = F.struct(F.lit(False).alias("real"), F.lit(0).cast("long").alias("h"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("base"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("mass")).cast(unit)
    done = "array<struct<real:boolean,doc_id:bigint,base:int,extra:int>>"

    def let(values: Column, body) -> Column:
        return F.transform(F.array(values), body)[0]

    def with_mass(x: Column, mass: Column) -> Column:
        return F.struct(x["real"].alias("real"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["base"].alias("base"), x["size"].alias("size"), mass.alias("mass"))

    def decided(x: Column, extra: int) -> Column:
        return F.struct(x["real"].alias("real"), x["doc_id"].alias("doc_id"), x["base"].alias("base"), F.lit(extra).alias("extra"))

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        room_a, room_x = a["size"] - a["mass"], x["size"] - x["mass"]
        moves = F.struct(F.least(a["mass"], room_x).alias("to_x"), F.least(x["mass"], room_a).alias("to_a"), room_a.alias("room_a"), room_x.alias("room_x"), _uniform(F.lit(seed), a["h"], x["h"]).alias("u"))

        def moved(m: Column) -> Column:
            total = a["mass"] + x["mass"]
            toward_x = m["u"] * (m["to_x"] + m["to_a"]) < m["to_a"]
            case = lambda open_, out: F.struct(open_.alias("open"), out.alias("out"))
            return (
                F.when(toward_x & (a["mass"] <= m["room_x"]), case(with_mass(x, total), decided(a, 0)))
                .when(toward_x, case(with_mass(a, a["mass"] - m["room_x"]), decided(x, 1)))
                .when(x["mass"] <= m["room_a"], case(with_mass(a, total), decided(x, 0)))
                .otherwise(case(with_mass(x, x["mass"] - m["room_a"]), decided(a, 1)))
            )

        return let(let(moves, moved), lambda r: F.struct(r["open"].cast(unit).alias("open"), F.array_append(state["done"], r["out"]).cast(done).alias("done")))

    start = F.struct(none.alias("open"), F.array().cast(done).alias("done"))
    return F.aggregate(F.transform(units, lambda x: F.struct(F.lit(True).alias("real"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["base"].alias("base"), x["size"].alias("size"), x["mass"].alias("mass"))), start, step)


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, copies): rows is (doc_id, source, size) of docs; copies is (doc_id, source, source_size, target, copies).

    Rows that share id and source are one document and get the same number of copies; a null source is a source of its
    own, the last; null ids of a source are one document. An empty text has size 0 and one copy if its source has a
    target; an empty table gives empty tables. Reruns agree: every random number is a hash of the ids and the seed.
    """
    rows = park(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    units = rows.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    targets = park(source_targets(units.select("source", "size", F.lit(1).cast("long").alias("units")), weights, most))
    deepest = targets.agg(F.max("units")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    # One row for each source; beyond a size Spark joins it by a shuffle.
    units = units.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    units = units.withColumn("base", F.floor("rate").cast("int")).withColumn("mass", (F.col("rate") - F.col("base")) * F.col("size"))
    sure = (F.col("mass") <= 0) | (F.col("size") == 0)
    units = park(units.select("doc_id", "source", "size", "source_size", "target", "base", "mass", "units", sure.alias("sure")))
    settled = units.filter("sure").select("doc_id", "source", F.when((F.col("size") == 0) & (F.col("target") > 0), 1).otherwise(F.col("base")).alias("copies"))
    out = [settled]
    open_ = units.filter("not sure").select("source", "doc_id", "base", "size", "mass", F.col("units").alias("slots"))
    level = 0
    while deepest > 1:
        open_ = open_.withColumn("slots", F.ceil(F.col("slots") / FAN)).withColumn("h", F.xxhash64(F.lit(seed + level), "doc_id", "source"))
        dealt = open_.groupBy("source", "slots", F.pmod(F.col("h"), F.col("slots")).alias("slot"))
        folded = dealt.agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "base", "size", "mass"))).alias("of"))
        folded = park(folded.select("source", "slots", _fold(F.col("of"), seed + level).alias("f")).select("source", "slots", "f.open", "f.done"))
        out.append(folded.select("source", F.explode("done").alias("x")).filter("x.real").select("x.doc_id", "source", (F.col("x.base") + F.col("x.extra")).alias("copies")))
        open_ = folded.select("source", "open.doc_id", "open.base", "open.size", "open.mass", "slots")
        deepest, level = -(-deepest // FAN), level + 1
    taken = (_uniform(F.lit(seed - 1), F.col("doc_id"), F.col("source")) * F.col("size") < F.col("mass")).cast("int")
    out.append(open_.select("doc_id", "source", (F.col("base") + taken).alias("copies")))
    copies = out[0]
    for more in out[1:]:
        copies = copies.unionByName(more)
    copies = copies.join(targets.drop("units").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return rows, copies


def _on(docs: DataFrame, copies: DataFrame, id_col: str, source_col: str) -> DataFrame:
    copies = copies.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), "source_size", "target", "copies")
    docs = docs.alias("docs")
    mine = (F.col(f"docs.{id_col}").cast("long").eqNullSafe(F.col("mix.mix_id"))) & (F.col(f"docs.{source_col}").cast("string").eqNullSafe(F.col("mix.mix_source")))
    return docs.join(copies.alias("mix"), mine)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row of docs as often as it was taken, with the columns of docs."""
    _, copies = mixed_copies(docs, id_col, text_col, source_col, weights, most, seed)
    rows = _on(docs, copies.filter("copies > 0"), id_col, source_col)
    (copy,) = unused(docs.columns, "mix_copy")
    return rows.select("docs.*", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies"))).alias(copy)).drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of each document."""
    rows, copies = mixed_copies(table(spark, sf_dir, "documents"))
    return _on(rows, copies, "doc_id", "source").select("docs.doc_id", "docs.size", "source_size", "target", (F.col("docs.size") * F.col("mix.copies")).alias("taken"))


QUERIES = {"op5_pivotal_mixing": query}
