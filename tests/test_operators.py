"""Operators whose results SQL does not tell, and properties of the others."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators import evaluate, joins, registry, sampling, sites, tables
from strandlake.operators import peaks as peak_tracks
from strandlake.streaming import events as streams


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def brute_evaluate(scores, true, threshold, window):
    """The scan, position by position."""
    if not true:
        return []
    free, out, waiting = sorted(true), [], set(true)
    for p in sorted(scores):
        near = [t for t in free if t in waiting and abs(p - t) <= window]
        if near and scores[p] >= threshold:
            waiting.discard(near[0])
            out.append((p, "TP"))
        elif near:
            continue
        else:
            out.append((p, "FP" if scores[p] >= threshold else "TN"))
    return sorted(out + [(t, "FN") for t in waiting])


def test_evaluation_equals_the_scan(spark):
    import random

    rng = random.Random(1)
    scores, true, want = [], [], []
    for g in range(25):
        s = {p: rng.random() for p in range(40) if rng.random() < 0.8}
        t = {p for p in range(40) if rng.random() < rng.choice([0, 0.1, 0.5])}
        scores += [(g, p, x) for p, x in s.items()]
        true += [(g, p) for p in t]
        want += [(g, *x) for x in brute_evaluate(s, t, 0.5, 2)]
    got = evaluate.evaluate(spark.createDataFrame(scores, "gene_id long, position long, score double"), spark.createDataFrame(true, "gene_id long, position long"), "gene_id", "long", "score")
    assert rows_of(got, "gene_id", "position", "pred_type") == sorted(want)
    thin = evaluate.evaluate(spark.createDataFrame(scores, "gene_id long, position long, score double"), spark.createDataFrame(true, "gene_id long, position long"), "gene_id", "long", "score", tn_factor=0.5)
    n = {r.pred_type: r.n for r in thin.groupBy("pred_type").agg(F.count("*").alias("n")).collect()}
    assert n["TN"] <= 0.5 * (n["TP"] + n["FP"] + n["FN"])


def test_greedy_junctions(spark):
    rows = [(1, 10, "donor", 0.9), (1, 12, "donor", 0.95), (1, 20, "acceptor", 0.5), (1, 30, "acceptor", 0.8), (1, 40, "donor", 0.99), (2, 5, "acceptor", 0.9)]
    df = spark.createDataFrame(rows, "g long, position long, site_type string, score double")
    assert rows_of(sites.greedy_junctions(df, ["g"]), "g", "donor_pos", "acceptor_pos") == [(1, 10, 30), (1, 12, 20)]


def test_peaks(spark):
    track = [0, 0.9, 0, 0.6, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.7, 0.2, 0]
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(track)], "g long, position long, score double")
    assert rows_of(peak_tracks.score_peaks(df, ["g"]), "position", "score") == [(1, 0.9), (13, 0.7)]


def test_stack_ensure_and_standardise(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2.5, 3)], "k double, w int")
    assert sorted(tables.stack(a, b).dtypes) == [("k", "double"), ("v", "string"), ("w", "int")]
    schema = T.StructType([T.StructField("w", T.LongType()), T.StructField("k", T.StringType())])
    assert rows_of(tables.ensure(a, schema), "w", "k") == [(None, "1")]
    once = tables.standardise(a.withColumnRenamed("v", "seqname"), {"seqname": "chrom", "k": "k"})
    assert once.columns == ["k", "chrom"] == tables.standardise(once, {"seqname": "chrom"}).columns
    assert [f.name for f in tables.extend(schema, b.withColumn("context_x", F.lit(1)))] == ["w", "k", "context_x"]
    assert tables.schema_differences(a, b) == {"only_first": ["v"], "only_second": ["w"], "types": [("k", "int", "double")]}


def test_overlap_join_has_no_repeats(spark):
    spans = [(k, "c", k * 3, k * 3 + 50) for k in range(30)]
    df = spark.createDataFrame(spans, "id long, chrom string, start long, end long")
    want = sorted((a[0], b[0]) for a in spans for b in spans if a[0] < b[0] and a[2] <= b[3] and b[2] <= a[3])
    for width in (7, 40, 1000):
        assert rows_of(joins.overlapping_pairs(df, "id", ["chrom"], bin_width=width), "id_1", "id_2") == want


def test_thinning_keeps_what_it_must(spark):
    rows = [(1, k, "TP" if k % 50 == 0 else "TN", 0.05, 0.05, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "gene_id long, position long, pred_type string, donor_score double, acceptor_score double, k long")
    out = sampling.thin_negatives(df, ["gene_id"], ["k"], radius=1)
    kept = {r.k: r.pred_type for r in out.collect()}
    assert all(k in kept for k in range(999) if k % 50 in (0, 1, 49))
    assert 5 <= len(kept) - sum(k % 50 in (0, 1, 49) for k in range(1000)) <= 45


def test_packing_and_registry(spark):
    assert sampling.pack_small({"1": 900, "2": 1200, "3": 300, "4": 800}, 1000) == [["2"], ["1", "4", "3"]]
    from strandlake.plans import domain

    assert domain and {"score_sum", "gene_errors"} <= set(registry.names())


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.read_events(spark, f"{tmp_path}/in")
    q = streams.tumbling(stream, "1 day", late="10000 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    want = streams.tumbling(events, "1 day")
    assert rows_of(spark.table("w"), "start", "event_type", "n") == rows_of(want, "start", "event_type", "n")
    q = streams.to_table(streams.distinct_events(stream, "10000 days"), f"{tmp_path}/out", f"{tmp_path}/c2")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == streams.distinct_events(events).count()


def test_blocks_one_hot_and_deltas(spark):
    from strandlake.functions import scores, sequences

    row = spark.range(1).select(
        sequences.context_blocks(F.lit("ACGTACG"), 3, 4).alias("b"),
        sequences.one_hot(F.lit("aN")).alias("h"),
        F.struct(*(c.alias(k) for k, c in scores.delta_of_tracks(F.array(*map(F.lit, [0.1, 0.2, 0.9])), F.array(*map(F.lit, [0.1, 0.7, 0.2])), 1).items())).alias("d"),
    ).first()
    assert [(x["index"], x["piece"]) for x in row.b] == [(0, "NNACGTA"), (1, "CGTACGN"), (2, "ACGNNNN")]
    assert row.h == [[1.0, 0.0, 0.0, 0.0], [0.0] * 4]
    assert (round(row.d.gain, 6), row.d.gain_at, round(row.d.loss, 6), row.d.loss_at) == (0.5, 0, 0.7, 1)


def test_tuning_pairs_and_numbers(spark):
    from strandlake.functions import coords
    from strandlake.operators import metrics

    df = spark.createDataFrame([(k, k / 10, k / 10 + (0.1 if k % 2 else 0.3)) for k in range(10)], "k long, a double, b double")
    best = metrics.tune(df, {f"{t}": F.col("a") >= t for t in (0.2, 0.5, 0.7)}, 0.45).first()
    assert (best.mask, best.rate) == ("0.5", 0.5)
    p = metrics.paired(df, "b", "a").first()
    assert p.n == 10 and round(p.mean_difference, 6) == 0.2 and p.t > 5
    s = spark.createDataFrame([(1, 10, "donor", 0.9, 1), (1, 12, "donor", 0.71, 1), (1, 20, "acceptor", 0.8, 1), (1, 30, "acceptor", 0.95, 1)], "g long, position long, site_type string, score double, wanted int")
    assert rows_of(sites.junctions_to_number(s, ["g"], "wanted"), "donor_pos", "acceptor_pos") == [(10, 20)]
    q = spark.createDataFrame([(1, 105, 100, 120), (1, 119, 100, 120), (2, 3, 100, 120), (2, 20, 100, 120)], "g long, p long, s long, e long")
    got = q.groupBy("g").agg(coords.position_kind(F.col("p"), F.col("s"), F.col("e")).alias("kind"))
    assert rows_of(got, "g", "kind") == [(1, "absolute"), (2, "relative")]
    assert rows_of(metrics.average_blocks(df.withColumn("g", F.lit(1)), ["g"], ["a"]), "a") == [(0.45,)]
