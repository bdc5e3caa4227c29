"""Splicing patterns against one gene at a time in plain Python, and hand-made cases of variants' impact and uncertainty."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import scores
from strandlake.functions.variants import record_class
from strandlake.operators import joins, patterns, sites
from strandlake.sources.variants import COMPREHENSIVE, PERMISSIVE, STRICT, with_splice_impact

SCHEMA = "gene_id int, position long, site_type string, delta_score double, is_canonical boolean, is_cryptic boolean"


def severity(deltas):
    sizes = [abs(d) for d in deltas]
    return (max(sizes) + sum(sizes) / len(sizes)) / 2


def brute(gene):
    """All patterns of one gene's (position, type, delta, canonical, cryptic), sorted."""
    out = []
    for a, b in zip(gene, gene[1:], strict=False):
        if not (a[3] and b[3] and a[2] < 0 and b[2] < 0):
            continue
        if (a[1], b[1]) == ("acceptor", "donor") and 50 <= b[0] - a[0] <= 5000:
            up = max((s for s in gene if s[1] == "donor" and s[0] < a[0]), key=lambda s: (s[0], s[2]), default=None)
            down = min((s for s in gene if s[1] == "acceptor" and s[0] > b[0]), key=lambda s: (s[0], s[2]), default=None)
            deltas = [a[2], b[2], *(s[2] for s in (up, down) if s and s[2] > 0)]
            trust = min(1, severity(deltas)) * (1.2 if min(abs(a[2]), abs(b[2])) > 0.5 else 1)
            out.append(("exon_skipping", a[0], b[0], len(deltas), severity(deltas), min(1, trust)))
        if (a[1], b[1]) == ("donor", "acceptor"):
            out.append(("intron_retention", a[0], b[0], 2, severity([a[2], b[2]]), min(1, severity([a[2], b[2]]))))
    for s in gene:
        if s[3] and s[2] < 0:
            for t in gene:
                if t[1] == s[1] and t[2] > 0 and abs(t[0] - s[0]) <= 300:
                    x = severity([s[2], t[2]])
                    out.append(("alternative_5ss" if s[1] == "donor" else "alternative_3ss", min(s[0], t[0]), max(s[0], t[0]), 2, x, min(1, x)))
        if s[4] and abs(s[2]) >= 0.2:
            near = min((t for t in gene if t[1] == s[1] and t[3]), key=lambda t: (abs(t[0] - s[0]), t[0]), default=None)
            deltas = [s[2]] + ([near[2]] if near else [])
            x = severity(deltas)
            out.append(("cryptic_activation" if s[2] > 0 else "cryptic_suppression", s[0], s[0], len(deltas), x, min(1, min(1, x) * (1.15 if s[2] > 0.8 else 1))))
    places = {s[0] for s in gene if s[2]}
    link = {p: {p} for p in places}
    for s in gene:
        for t in gene:
            if s[2] * t[2] > 0 and abs(s[0] - t[0]) <= 600:
                link[s[0]].add(t[0])
    while places:
        now, grown = set(), {places.pop()}
        while grown != now:
            now, grown = grown, set().union(*(link[p] for p in grown))
        places -= now
        own = [s for s in gene if s[0] in now]
        if len(now) >= 3 and sum(s[2] > 0 for s in own) >= 2 and sum(s[2] < 0 for s in own) >= 2:
            x = severity([s[2] for s in own])
            out.append(("complex_pattern", own[0][0], own[-1][0], len(own), x, min(1, x)))
    return out


def test_brute_force(spark):
    rng = random.Random(6)
    genes = {}
    for g in range(40):
        seen = {(rng.randint(1, 2500), rng.choice(["donor", "acceptor"])) for _ in range(rng.randint(1, 30))}
        genes[g] = [(p, t, rng.choice([0.0, 0.9, 0.6, 0.3, 0.1, -0.1, -0.4, -0.7, -1.5]), c, rng.random() < 0.8 and not c) for p, t in sorted(seen) for c in [rng.random() < 0.6]]
        if g % 3 == 0:  # places with a donor and an acceptor
            genes[g] = sorted({(p // 400 * 400, t): (p // 400 * 400, t, *more) for p, t, *more in genes[g]}.values())
    frame = spark.createDataFrame([(g, *s) for g, own in genes.items() for s in own], SCHEMA)
    want = sorted((g, *x[:4], round(x[4], 6), round(x[5], 6)) for g, own in genes.items() for x in brute(own))
    got = sorted((r[0], *r[1:5], round(r.severity, 6), round(r.confidence, 6)) for r in patterns.ranked_patterns(frame, ["gene_id"]).collect())
    assert {w[1] for w in want} == {*dict(patterns.PRIORITY), "cryptic_suppression"}
    assert got == want


def test_rank_and_subtype(spark):
    rows = [(1, p, t, d, True, False) for p, t, d in [(0, "donor", 0.5), (0, "acceptor", -0.5), (100, "donor", 0.5), (100, "acceptor", -0.5), (200, "donor", 0.1), (200, "acceptor", -0.2)]]
    (r,) = patterns.complex_groups(spark.createDataFrame(rows, SCHEMA), ["gene_id"]).collect()
    assert (r.first_position, r.last_position, r.num_sites, r.activated, r.suppressed, r.subtype) == (0, 200, 6, 3, 3, "multiple_exon_changes")
    ranked = {x.pattern_type: x for x in patterns.ranked_patterns(spark.createDataFrame(rows, SCHEMA), ["gene_id"]).collect()}
    assert ranked["complex_pattern"].rank_score == pytest.approx(0.7 * r.confidence + 0.3 * 0.7)
    assert patterns.ranked_patterns(spark.createDataFrame([], SCHEMA), ["gene_id"]).count() == 0


@pytest.mark.parametrize(("text", "mode", "want"), [
    ("SO:0001575", COMPREHENSIVE, (True, "direct_splice_site", "high")), ("intron_variant|splice_acceptor_variant", COMPREHENSIVE, (True, "direct_splice_site", "high")),
    ("missense_variant,Splice_Region_Variant", COMPREHENSIVE, (True, "exonic_boundary_effect", "high")), ("so:0001629", COMPREHENSIVE, (True, "polypyrimidine_tract_effect", "high")),
    ("intron_variant", COMPREHENSIVE, (True, "intronic_cryptic_site", "medium")), ("intron_variant", STRICT, (False, "none", "none")), ("stop_lost", COMPREHENSIVE, (True, "exonic_ese_ess_effect", "low")),
    ("splice_donor_5th_base_variant", COMPREHENSIVE, (True, "exonic_extended_region", "low")), ("3_prime_utr_variant", COMPREHENSIVE, (True, "utr_regulatory_effect", "low")), ("inframe_deletion", COMPREHENSIVE, (True, "structural_splice_effect", "low")),
    ("start_lost", COMPREHENSIVE, (True, "indirect_splice_effect", "low")), ("near the branch_point", COMPREHENSIVE, (True, "keyword_based_detection", "low")), ("a mutation", COMPREHENSIVE, (False, "none", "none")),
    ("a mutation", PERMISSIVE, (True, "keyword_based_detection", "low")), ("an exon", STRICT, (False, "none", "none")), (".", PERMISSIVE, (False, "none", "none")), (None, PERMISSIVE, (False, "none", "none")),
])
def test_impact(spark, text, mode, want):
    row = with_splice_impact(spark.createDataFrame([(text,)], "t string"), F.col("t"), F.lit("x=1"), mode=mode).first()
    assert (row.affects_splicing, row.splice_mechanism, row.splice_confidence) == want


def test_terms_and_classes(spark):
    row = with_splice_impact(spark.createDataFrame([("SO:0001627", "splice_donor_variant")], "a string, b string"), F.col("a"), F.col("b")).first()
    assert row.splice_terms == ["SO:0001575", "SO:0001627"]
    rows = spark.createDataFrame([("A", "."), ("A", "C"), ("AC", "A"), ("A", "AC"), ("AC", "GT")], "r string, a string")
    assert [x[0] for x in rows.select(record_class(F.col("r"), F.col("a"))).collect()] == ["unknown", "SNV", "deletion", "insertion", "complex"]


@pytest.mark.parametrize(("d", "a", "n", "strategy", "want"), [
    (0.1, 0.0, 0.9, "hybrid_entropy", (0.1, True, "confidence_zone;high_variance(0.162)")), (0.0, 0.0, 0.0, "hybrid_entropy", (0.0, True, "low_spread(0.000)")),
    (0.001, 0.001, 0.5, "confidence_only", (0.001, False, "")), (0.4, 0.3, 0.3, "entropy_only", (0.4, True, "confidence_zone;high_entropy(0.991);low_spread(0.100)")), (0.9, 0.0, 0.1, "entropy_only", (0.9, False, "high_variance(0.162)")),
])
def test_uncertainty(spark, d, a, n, strategy, want):
    u = scores.uncertainty(F.col("d"), F.col("a"), F.col("n"), strategy=strategy)
    r = spark.createDataFrame([(d, a, n)], "d double, a double, n double").select(*(u[k].alias(k) for k in ("max_score", "is_uncertain", "reasons"))).first()
    assert tuple(r) == want


def test_long_groups_take_linear_time(spark):
    """Two hundred thousand rows of one gene: frames that end at the last row would take minutes."""
    rows = spark.range(200_000).select(F.lit(1).alias("gene_id"), (F.col("id") * 3).alias("position"), (F.col("id") % 7 == 0).alias("from_"), (F.col("id") % 11 == 0).alias("to"))
    assert joins.next_position(rows, ["gene_id"], F.col("from_"), F.col("to")).count() == 28_571
    found = sites.nearest_of(rows, ["gene_id"], F.col("to")).agg(F.max(F.abs(F.col("nearest_marked") - F.col("position"))).alias("m")).first()
    assert found.m == 24  # at the end there is none above
