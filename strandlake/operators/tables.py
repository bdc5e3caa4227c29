"""Schemas, unions, encodings, checks, and nesting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences
from .orderstats import quantiles

# Groups of columns that a training table leaves out.
LEAKAGE = ("splice_type", "pred_type", "true_position", "predicted_position")
METADATA = ("gene_name", "transcript_id", "window_start", "window_end")


def standardise(rows: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Renames columns to the names that the engine uses, where those are not taken; doing it twice changes nothing."""
    taken, names = set(rows.columns), {}
    for old in rows.columns:
        new = synonyms.get(old)
        if new and new not in taken:
            names[old] = new
            taken.add(new)
    return rows.withColumnsRenamed(names)


def ensure(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of the schema, in its order: missing ones null, others dropped, all cast."""
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def extend(schema: T.StructType, *frames: DataFrame, prefix: str = "context_") -> T.StructType:
    """The schema with every further column of the frames; those with the prefix are doubles."""
    fields = {f.name: f for f in schema}
    for frame in frames:
        for f in frame.schema:
            fields.setdefault(f.name, T.StructField(f.name, T.DoubleType() if f.name.startswith(prefix) else f.dataType))
    return T.StructType(list(fields.values()))


def schema_differences(a: DataFrame, b: DataFrame) -> dict[str, list]:
    """Columns that only one has, and those of other types."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"only_first": sorted(x.keys() - y.keys()), "only_second": sorted(y.keys() - x.keys()), "types": sorted((c, x[c], y[c]) for c in x.keys() & y.keys() if x[c] != y[c])}


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name with nulls for missing columns; where types differ, double if one of them is a fraction, else string."""
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for c, kind in frame.dtypes:
            kinds.setdefault(c, set()).add(kind)
    to = {c: "double" if k <= {"double", "float", "int", "bigint"} and k & {"double", "float"} else "bigint" if k <= {"int", "bigint"} else "string" for c, k in kinds.items() if len(k) > 1}
    cast = [frame.withColumns({c: F.col(c).cast(k) for c, k in to.items() if c in frame.columns}) for frame in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def select_where(rows: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that meet every condition: a value, or a list of values."""
    for c, v in conditions.items():
        rows = rows.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return rows


def drop_groups(rows: DataFrame, *groups: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return rows.drop(*(c for g in groups for c in g if c not in keep))


def label_code(col: str = "splice_type", codes: dict[str, int] | None = None) -> Column:
    """0 for neither or null, 1 donor, 2 acceptor."""
    out = F.lit(0)
    for name, code in (codes or {"donor": 1, "acceptor": 2}).items():
        out = F.when(F.col(col) == name, code).otherwise(out)
    return out


def positive_label(rows: DataFrame, positive: str = "FP", col: str = "pred_type", label: str = "label") -> DataFrame:
    """rows with a label of 1 where col is the positive class, else 0, in place of col; unchanged if they have a label."""
    if label in rows.columns:
        return rows
    return rows.withColumn(label, F.coalesce((F.col(col) == positive).cast("int"), F.lit(0))).drop(col)


def fill_by(rows: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nulls of each named column as the value given for it; names that rows don't have are passed over."""
    return rows.fillna({c: v for c, v in values.items() if c in rows.columns})


def fill_by_kind(rows: DataFrame, number: float = 0.0, text: str = "unknown", flag: bool = False) -> DataFrame:
    """Nulls as a sentinel of their column's kind: numbers, texts and flags."""
    kinds = dict(rows.dtypes)
    return rows.fillna({c: flag if k == "boolean" else text if k == "string" else number for c, k in kinds.items() if k in ("boolean", "string", "double", "float", "int", "bigint")})


def kmer_features(rows: DataFrame, key: str, seq: str, sizes: Sequence[int], least: int = 1, valid: bool = True) -> DataFrame:
    """(key, {k}mer_X for each k-mer, gc_content, sequence_length, sequence_complexity): counts, 0 where there are none.

    Only k-mers that occur `least` times in all sequences together have a column; their names, at most 4^k for letters of
    DNA, are gathered on the driver. Keys name one row each.
    """
    out, columns = rows, []
    for k in sizes:
        bag = sequences.kmer_bag(F.col(seq), k)
        bag = F.filter(bag, sequences.valid_kmer) if valid else bag
        counts = rows.select(F.explode(bag).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        names = sorted(r.kmer for r in counts.select("kmer").collect())
        each = rows.select(key, F.explode(bag).alias("kmer")).groupBy(key).pivot("kmer", names).agg(F.count(F.lit(1)))
        out = out.join(each.select(F.col(key), *(F.col(f"`{n}`").alias(f"{k}mer_{n}") for n in names)), key, "left")
        columns += [F.coalesce(f"{k}mer_{n}", F.lit(0)).cast("long").alias(f"{k}mer_{n}") for n in names]
    gc, size, complexity = sequences.gc_content(F.col(seq)), F.length(seq).cast("long"), sequences.composition_entropy(F.col(seq))
    return out.select(key, *columns, F.coalesce(gc, F.lit(0.0)).alias("gc_content"), F.coalesce(size, F.lit(0)).alias("sequence_length"), F.coalesce(complexity, F.lit(0.0)).alias("sequence_complexity"))


def ordinal(rows: DataFrame, col: str, name: str) -> DataFrame:
    """rows with the place of col among its distinct values in order, from 0; a null has none."""
    codes = rows.select(col).filter(F.col(col).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(col)) - 1)
    return rows.join(codes, col, "left")


def fill_nulls(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null or empty strings become unknown, null numbers the median of their column (0 without any)."""
    kinds = {c: k for c, k in rows.dtypes if columns is None or c in columns}
    numbers = [c for c, k in kinds.items() if k in ("double", "float", "int", "bigint")]
    texts = {c: F.when(F.col(c).isNull() | (F.col(c) == ""), "unknown").otherwise(F.col(c)) for c, k in kinds.items() if k == "string"}
    out = rows.withColumns(texts) if texts else rows
    if not numbers:
        return out
    medians = quantiles(rows, {c: F.col(c) for c in numbers}, [0.5])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0]).cast(kinds[c]), F.lit(0).cast(kinds[c])) for c in numbers})


def null_shares(rows: DataFrame) -> DataFrame:
    """(column, share) of columns with nulls or NaN, in one aggregation."""
    bad = {c: F.col(c).isNull() | F.isnan(c) if k in ("double", "float") else F.col(c).isNull() for c, k in rows.dtypes}
    one = rows.agg(*(F.avg(v.cast("double")).alias(c) for c, v in bad.items()))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in bad)))
    return one.select(each.alias("x")).select("x.*").filter("share > 0")


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return rows.withColumn("n_same", F.count("*").over(Window.partitionBy(*keys))).filter("n_same > 1").drop("n_same")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in an explicit order."""
    return rows.withColumn("key_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("key_rank = 1").drop("key_rank")


def stage_counts(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, n): how many rows pass each stage and all before it, from one aggregation."""
    so_far, aggs = F.lit(True), [F.count("*").alias("s0")]
    for k, test in enumerate(stages.values(), 1):
        so_far = so_far & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(so_far).alias(f"s{k}"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(f"s{k}").alias("n")) for k, n in enumerate(["all", *stages]))))
    return rows.agg(*aggs).select(each.alias("x")).select("x.*")


def nest(rows: DataFrame, by: Sequence[str], columns: Sequence[str], at: str = "position", down: Column | None = None) -> DataFrame:
    """One row a group with parallel arrays in order of `at`, or in falling order where `down` (of the group) holds."""
    up = F.sort_array(F.collect_list(F.struct(F.col(at), *(F.col(c) for c in columns))))
    out = rows.groupBy(*by).agg(up.alias("nested"))
    if down is not None:
        out = out.withColumn("nested", F.when(down, F.reverse("nested")).otherwise(F.col("nested")))
    return out.select(*by, *(F.col(f"nested.{c}").alias(c) for c in (at, *columns)))


def unnest(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of parallel arrays."""
    return rows.select(*by, F.explode(F.arrays_zip(*columns)).alias("x")).select(*by, *(F.col(f"x.{c}") for c in columns))


def counts_by(rows: DataFrame, by: Sequence[str], col: str, values: Sequence[str]) -> DataFrame:
    """One column of counts for each value, 0 where there are none."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(col) == v).alias(v) for v in values))


def bins_by_quantile(rows: DataFrame, col: str, n: int) -> DataFrame:
    """rows with bin 0 to n: how many of the n + 1 quantile edges lie at or below the value, less 1."""
    edges = quantiles(rows, {col: F.col(col)}, [k / n for k in range(n + 1)])[col]
    passed = [F.coalesce((F.col(col) >= e).cast("int"), F.lit(0)) for e in edges if e is not None]
    return rows.withColumn("bin", reduce(lambda a, b: a + b, passed, F.lit(0)) - 1)
