"""Joins by intervals, bands and nearest positions. Large sides meet in bins of the position, never in a cross product."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Rows of either side of a cell that one slice holds where pairs are dealt out, and pairs and rows that are worth a task.
EDGE, WORTH = 8192, 1 << 20


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def dealt_join(a: DataFrame, b: DataFrame, keys: Sequence[tuple[str, str]], more: Column | None = None, edge: int = EDGE) -> DataFrame:
    """The inner join of a and b, which share no column's name, on the pairs of keys and on `more`, dealt out by its pairs.

    A key with more than `edge` rows of a side is cut into slices of about so many by a hash of the row, and any two slices
    meet in a place of their own; there are as many tasks as the pairs are worth, not as the bytes of rows are. Both sides are
    read twice, so they should be stored.
    """
    names = [f"dealt_key_{k}" for k in range(len(keys))]
    sides = [rows.select(*(F.col(pair[k]).alias(n) for pair, n in zip(keys, names, strict=True)), F.lit(1 - k).alias("n_1"), F.lit(k).alias("n_2")) for k, rows in enumerate((a, b))]
    cells = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.sum("n_1").alias("n_1"), F.sum("n_2").alias("n_2"))
    cells = cells.withColumns({f"cuts_{k}": F.ceil(F.col(f"n_{k}") / edge).cast("int") for k in (1, 2)})
    sums = cells.agg(F.sum(F.col("n_1") + F.col("n_2")).alias("rows"), F.sum(F.col("n_1") * F.col("n_2").cast("double")).alias("pairs"), F.sum(F.col("cuts_1") * F.col("cuts_2").cast("double")).alias("places")).first()
    tasks = max(1, int(-(-(sums.rows or 0) // WORTH)), int(min(-(-(sums.pairs or 0) // WORTH), sums.places or 0)))
    hot = cells.filter(((F.col("n_1") > edge) | (F.col("n_2") > edge)) & (F.col("n_1") > 0) & (F.col("n_2") > 0))  # at most one for each `edge` rows

    def sliced(rows: DataFrame, k: int) -> DataFrame:
        own, other = (F.coalesce(f"cuts_{x}", F.lit(1)) for x in (k, 3 - k))
        met = reduce(lambda x, y: x & y, [F.col(pair[k - 1]) == F.col(n) for pair, n in zip(keys, names, strict=True)])
        out = rows.join(F.broadcast(hot.select(*names, "cuts_1", "cuts_2")), met, "left")
        out = out.withColumn(f"dealt_{k}", F.pmod(F.xxhash64(*rows.columns), own).cast("int")).withColumn(f"dealt_other_{k}", F.explode(F.sequence(F.lit(0), other - 1)))
        return out.select(*rows.columns, f"dealt_{k}", f"dealt_other_{k}")

    on = [*keys, ("dealt_1", "dealt_other_2"), ("dealt_other_1", "dealt_2")]
    x, y = (sliced(rows, k + 1).repartition(tasks, *(pair[k] for pair in on)) for k, rows in enumerate((a, b)))
    meet = reduce(lambda p, q: p & q, [F.col(p) == F.col(q) for p, q in on])
    return x.join(y, meet if more is None else meet & more).drop("dealt_1", "dealt_2", "dealt_other_1", "dealt_other_2")


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end"), bin_width: int = 10_000, suffixes: tuple[str, str] = ("_1", "_2"), edge: int | None = None) -> DataFrame:
    """Pairs of rows with equal `on` whose inclusive intervals overlap; all columns with suffixes.

    Each interval stands in every bin that it touches, and a pair is kept in the bin where the later of the two starts,
    so no pair comes twice. With an `edge` the pairs of a bin are dealt out (`dealt_join`).
    """
    a = left.select(*(F.col(c).alias(c + suffixes[0]) for c in left.columns))
    b = right.select(*(F.col(c).alias(c + suffixes[1]) for c in right.columns))
    (s1, e1), (s2, e2) = ((F.col(x + suffixes[0]) for x in left_span), (F.col(x + suffixes[1]) for x in right_span))
    a = a.withColumn("bin_1", _bins(s1, e1, bin_width))
    b = b.withColumn("bin_2", _bins(s2, e2, bin_width))
    meet = reduce(lambda x, y: x & y, [F.col(c + suffixes[0]) == F.col(c + suffixes[1]) for c in on], F.col("bin_1") == F.col("bin_2"))
    overlap = (s1 <= e2) & (e1 >= s2) & (F.col("bin_1") == F.floor(F.greatest(s1, s2) / bin_width))
    found = a.join(b, meet & overlap) if edge is None else dealt_join(a, b, [*((c + suffixes[0], c + suffixes[1]) for c in on), ("bin_1", "bin_2")], overlap, edge)
    return found.drop("bin_1", "bin_2")


def overlapping_pairs(spans: DataFrame, id_col: str, on: Sequence[str], both_directions: bool = False, bin_width: int = 10_000) -> DataFrame:
    """Pairs of different ids with overlapping intervals; each pair once, the smaller id first, unless both directions are asked for."""
    pairs = overlap_join(spans, spans, on, bin_width=bin_width)
    a, b = F.col(f"{id_col}_1"), F.col(f"{id_col}_2")
    return pairs.filter(a != b if both_directions else a < b)


def overlap_counts(spans: DataFrame, id_col: str, on: Sequence[str], bin_width: int = 10_000) -> DataFrame:
    """(id, num_overlaps): how many other intervals each one overlaps; those without any have 0."""
    n = overlapping_pairs(spans, id_col, on, both_directions=True, bin_width=bin_width).groupBy(F.col(f"{id_col}_1").alias(id_col)).agg(F.count("*").alias("num_overlaps"))
    return spans.select(id_col).join(n, id_col, "left").select(id_col, F.coalesce("num_overlaps", F.lit(0)).alias("num_overlaps"))


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], tolerance: int, left_at: str = "position", right_at: str = "position", suffix: str = "_r") -> DataFrame:
    """Pairs with equal `on` and positions at most tolerance apart; right columns get a suffix.

    Bins are as wide as the band, and the left row looks into its own bin and the two beside it.
    """
    width = 2 * tolerance + 1
    a = left.withColumn("band_bin", F.explode(F.array(*(F.floor(F.col(left_at) / width) + k for k in (-1, 0, 1)))))
    b = right.select(*(F.col(c).alias(c + suffix) for c in right.columns)).withColumn("band_bin_r", F.floor(F.col(right_at + suffix) / width))
    meet = reduce(lambda x, y: x & y, [F.col(c) == F.col(c + suffix) for c in on], F.col("band_bin") == F.col("band_bin_r"))
    return a.join(b, meet & (F.abs(F.col(left_at) - F.col(right_at + suffix)) <= tolerance)).drop("band_bin", "band_bin_r")


def near_semi(left: DataFrame, right: DataFrame, on: Sequence[str], tolerance: int, left_at: str = "position", right_at: str = "position", anti: bool = False) -> DataFrame:
    """Rows of left with (anti: without) a row of right with equal `on` at most tolerance away; right rows stand in their bin and the two beside it."""
    width = 2 * tolerance + 1
    near = right.select(*on, F.col(right_at).alias("near_at"), F.explode(F.array(*(F.floor(F.col(right_at) / width) + k for k in (-1, 0, 1)))).alias("near_bin"))
    meet = reduce(lambda x, y: x & y, [left[c] == near[c] for c in on], F.floor(left[left_at] / width) == near["near_bin"])
    return left.join(near, meet & (F.abs(left[left_at] - near["near_at"]) <= tolerance), "left_anti" if anti else "left_semi")


def next_position(rows: DataFrame, by: Sequence[str], from_: Column, to: Column, at: str = "position") -> DataFrame:
    """Rows where from_ holds, with next_position: the smallest later position of their group where `to` holds; rows without one go."""
    after = Window.partitionBy(*by).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, -1)  # a frame that ends at the last row would be read anew for each row
    found = rows.withColumn("next_position", F.min(F.when(to, F.col(at))).over(after))
    return found.filter(from_ & F.col("next_position").isNotNull())


def containing(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str = "position", tolerance: int = 0, policy: str = "longest", most: int = 1, keep_unmatched: bool = True, span_id: str = "transcript_id", bin_width: int = 10_000, point_key: Sequence[str] | None = None) -> DataFrame:
    """Each point with up to `most` intervals that contain it: the longest ones, or those whose boundary is closest."""
    key = list(point_key or [*on, at])
    wide = spans.select(*on, F.col(span_id), F.col("start").alias("tx_start"), F.col("end").alias("tx_end"))
    binned = wide.withColumn("span_bin", _bins(F.col("tx_start") - tolerance, F.col("tx_end") + tolerance, bin_width)).withColumnsRenamed({c: f"{c}_s" for c in on})
    meet = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{c}_s") for c in on], F.floor(F.col(at) / bin_width) == F.col("span_bin"))
    inside = F.col(at).between(F.col("tx_start") - tolerance, F.col("tx_end") + tolerance)
    found = points.join(binned, meet & inside, "left" if keep_unmatched else "inner").drop("span_bin", *(f"{c}_s" for c in on))
    length, edge = F.col("tx_end") - F.col("tx_start"), F.least(F.abs(F.col(at) - F.col("tx_start")), F.abs(F.col("tx_end") - F.col(at)))
    order = [length.desc(), F.col(span_id)] if policy == "longest" else [edge.asc(), F.col(span_id)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return found.withColumn("containing_rank", rank).filter(F.col("containing_rank") <= most).drop("containing_rank")


def three_tier(points: DataFrame, sites: DataFrame, spans: DataFrame, on: Sequence[str], at: str = "position", reach: int = 50, target: str = "transcript_id") -> DataFrame:
    """points with `target` by the first tier that has one: a site at the position, an interval around it, a site within reach; else unknown."""
    exact = sites.groupBy(*on, at).agg(F.min(target).alias("exact_target"))
    out = points.join(exact, [*on, at], "left")
    out = containing(out, spans, on, at, span_id=target).withColumnRenamed(target, "span_target").drop("tx_start", "tx_end")
    near = band_join(points.select(*on, at).distinct(), sites.select(*on, at, target), on, reach, at, at)
    gap = F.abs(F.col(at) - F.col(f"{at}_r"))
    near = near.groupBy(*on, at).agg(F.min(F.struct(gap.alias("gap"), F.col(f"{target}_r").alias("near_target"))).alias("near"))
    out = out.join(near, [*on, at], "left")
    return out.withColumn(target, F.coalesce("exact_target", "span_target", "near.near_target", F.lit("unknown"))).drop("exact_target", "span_target", "near")


def join_without_repeats(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join; columns that both sides have come from the left."""
    return left.join(right.drop(*(c for c in right.columns if c in left.columns and c not in on)), list(on), how)


def chain_left(first: DataFrame, *others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left joins one after the other."""
    return reduce(lambda a, b: join_without_repeats(a, b, on, "left"), others, first)


def missing_rows(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of left rows that right does not have; repeats stay."""
    return left.join(right, list(on), "left_anti").select(*on)


def common_to(sources: dict[str, DataFrame], key: str, least: int | None = None) -> DataFrame:
    """Keys that `least` of the sources have (default: all)."""
    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("source")) for name, df in sources.items()])
    return rows.groupBy(key).agg(F.countDistinct("source").alias("n_sources")).filter(F.col("n_sources") >= (least or len(sources)))


def entity_pairs(first: DataFrame, second: DataFrame, least_overlap: float = 0.5, bin_width: int = 10_000, edge: int = EDGE) -> DataFrame:
    """(id_1, id_2, strategy, confidence) of genes (id, symbol, chrom, start, end): by id, by symbol, by place.

    A pair comes once, by the first of the three that finds it. A symbol that either side has more than once gives 0.7
    instead of 0.9; a place gives 0.5 + 0.4 * overlap over the longer length. Two rows tell by their own ids and symbols
    which strategy is the first, so pairs are not shuffled, but for those of an id that a side repeats. Both sides are stored
    once, not computed anew for each strategy, and a symbol or place with many genes is dealt out (`dealt_join`).
    """
    columns, spark = ["id", "symbol", "chrom", "start", "end"], first.sparkSession

    def counted(rows: DataFrame) -> DataFrame:
        lone = F.when(F.col("symbol").isNull(), F.col("id"))  # genes without a symbol are no group
        n, repeated = F.count("*").over(Window.partitionBy("symbol", lone)), F.count("*").over(Window.partitionBy("id")) > 1
        rows.select(*columns, n.alias("n"), repeated.alias("repeated")).write.parquet(at := scratch_dir(spark, "genes"))
        return spark.read.parquet(at)

    def pairs(a: DataFrame, b: DataFrame, *turn: str) -> DataFrame:
        """(id_1, id_2, rank, confidence) of two rows, of one turn if rows have turns, by their first strategy."""
        one, two = (rows.select(*columns, "n", *turn).withColumnsRenamed({c: f"{c}_{k}" for c in (*columns, "n", *turn)}) for k, rows in ((1, a), (2, b)))
        met = [(f"{c}_1", f"{c}_2") for c in turn]
        same_id, same_symbol = (F.coalesce(F.col(f"{c}_1") == F.col(f"{c}_2"), F.lit(False)) for c in ("id", "symbol"))
        by_id = one.join(two, [F.col(x) == F.col(y) for x, y in (*met, ("id_1", "id_2"))]).select("id_1", "id_2", F.lit(1).alias("rank"), F.lit(1.0).alias("confidence"))
        named = (rows.filter(F.col(f"symbol_{k}").isNotNull()) for k, rows in ((1, one), (2, two)))
        by_symbol = dealt_join(*named, [*met, ("symbol_1", "symbol_2")], edge=edge).filter(~same_id)
        by_symbol = by_symbol.select("id_1", "id_2", F.lit(2).alias("rank"), F.when((F.col("n_1") > 1) | (F.col("n_2") > 1), 0.7).otherwise(0.9).alias("confidence"))
        placed = overlap_join(a.select(*columns, *turn), b.select(*columns, *turn), ["chrom", *turn], bin_width=bin_width, edge=edge).filter(~same_id & ~same_symbol)
        shared = F.least("end_1", "end_2") - F.greatest("start_1", "start_2") + 1
        share = shared / F.greatest(F.col("end_1") - F.col("start_1") + 1, F.col("end_2") - F.col("start_2") + 1)
        by_place = placed.withColumn("share", share).filter(F.col("share") >= least_overlap).select("id_1", "id_2", F.lit(3).alias("rank"), (0.5 + 0.4 * F.col("share")).alias("confidence"))
        return by_id.unionByName(by_symbol).unionByName(by_place)

    a, b = counted(first), counted(second)
    once = pairs(*(rows.filter("not repeated") for rows in (a, b)))
    name = F.element_at(F.array(F.lit("id"), F.lit("symbol"), F.lit("coordinate")), F.col("rank"))
    if a.unionByName(b).filter("repeated").isEmpty():
        return once.select("id_1", "id_2", name.alias("strategy"), "confidence")
    # Two rows meet in one turn: 1 where the second side alone repeats its id, 2 where the first one does.
    again_a = a.withColumn("turn", F.when(F.col("repeated"), 2).otherwise(1))
    again_b = b.withColumn("turn", F.explode(F.when(F.col("repeated"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    again = pairs(again_a, again_b, "turn").groupBy("id_1", "id_2").agg(F.min(F.struct("rank", "confidence")).alias("best")).select("id_1", "id_2", "best.rank", "best.confidence")
    return once.unionByName(again).select("id_1", "id_2", name.alias("strategy"), "confidence")


def overlay(base: DataFrame, meta: DataFrame, on: Sequence[str], scores: Sequence[str], mode: str = "hybrid", low: float = 0.02, high: float = 0.8) -> DataFrame:
    """base with final scores: where the base is uncertain (hybrid) or everywhere (meta_only), those of meta.

    meta has the scores with `_meta`. prediction_source tells which one was taken, confidence_category how sure the base was.
    """
    best = F.greatest(*(F.col(c) for c in scores if not c.startswith("neither")))
    has = F.col("meta_there").isNotNull()
    doubtful = (best >= low) & (best < high)
    use = {"hybrid": doubtful & has, "meta_only": has, "base_only": F.lit(False)}[mode]
    out = base.join(meta.select(*on, *(f"{c}_meta" for c in scores), F.lit(1).alias("meta_there")), list(on), "left")
    final = {f"{c}_final": F.when(use, F.col(f"{c}_meta")).otherwise(F.col(c)) for c in scores}
    category = F.when(best < low, "low").when(best >= high, "high").otherwise("uncertain")
    return out.withColumns({**final, "prediction_source": F.when(use, "meta_model").otherwise("base_model"), "confidence_category": category}).drop("meta_there", *(f"{c}_meta" for c in scores))
