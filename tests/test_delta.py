"""Delta scores against one variant at a time in plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import delta

REACH, FLANK, WIDTH = 6, 3, 10


def turned(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def scores_of(s, flank):
    """(acceptor, donor) of each place, letter by letter."""
    c = ["ACGT".find(x) if x in "ACGT" else 0 for x in s]
    return [((16 * c[i - 1] + 4 * c[i] + c[i + 1]) / 100, (c[i] + 4 * c[i + 1] + 16 * c[i + 2]) / 100) for i in range(flank, len(s) - flank)]


def one(genome, gene, pos, ref, alt, mask):
    """What a variant has for one gene: None where it is skipped."""
    half = REACH + FLANK
    seq = genome[gene["chrom"]]
    if any(c in alt for c in ".*<>-") or len(ref) > 2 * REACH or pos - half < 1 or pos + half > len(seq) or seq[pos - 1 : pos - 1 + len(ref)] != ref:
        return None
    if len(ref) > 1 and len(alt) > 1:
        return (None,) * 8
    own = "".join(seq[p - 1] if gene["start"] <= p <= gene["end"] else "N" for p in range(pos - half, pos + half + 1))
    other = own[:half] + alt + own[half + len(ref) :]
    back = gene["strand"] == "-"
    a, b = (scores_of(turned(x) if back else x, FLANK) for x in (own, other))
    a, b = (y[::-1] if back else y for y in (a, b))
    if len(ref) > 1:
        b = b[: REACH + 1] + [(0, 0)] * (len(ref) - 1) + b[REACH + 1 :]
    elif len(alt) > 1:
        b = b[:REACH] + [tuple(max(x[k] for x in b[REACH : REACH + len(alt)]) for k in (0, 1))] + b[REACH + len(alt) :]
    edges = sorted({e for x in gene["exons"] for e in x})
    edge = min((e - pos for e in edges), key=lambda e: (abs(e), e), default=None)
    values, places = [], []
    for site in (0, 1):
        for sign in (1, -1):
            change = [sign * (y[site] - x[site]) for x, y in zip(a, b, strict=True)]
            k = change.index(max(change))
            at_edge = k - REACH == edge
            values.append(0.0 if mask and at_edge == (sign == 1) else round(change[k], 2))
            places.append(k - REACH)
    return (*values, *places)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    genome = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("chr1", 200), ("chr2", 75), ("chrX", 20))}
    genes = [
        {"gene_id": 1, "chrom": "chr1", "strand": "+", "start": 20, "end": 180, "exons": [(20, 60), (90, 180)]},
        {"gene_id": 2, "chrom": "chr1", "strand": "-", "start": 100, "end": 200, "exons": [(100, 130), (130, 200)]},
        {"gene_id": 3, "chrom": "chr2", "strand": "-", "start": 1, "end": 75, "exons": [(1, 30)]},
        {"gene_id": 4, "chrom": "chrX", "strand": "+", "start": 1, "end": 20, "exons": []},
    ]
    variants = []
    for k in range(300):
        chrom = rng.choice(list(genome))
        pos = rng.randint(1, len(genome[chrom]))
        ref = genome[chrom][pos - 1 : pos - 1 + rng.choice([1, 1, 2, 5])]
        alt = rng.choice([ref[0], "A", "C", "G", "T", ref[0] + "GT", "ACGTA", "<DEL>", "*", "."])
        variants.append((k, chrom, pos, rng.choice([ref, ref, ref, "ACGTACGTACGTAC", "GG"]) or "A", alt))
    return genome, genes, variants


@pytest.mark.parametrize("mask", [False, True])
@pytest.mark.parametrize("prefix", ["", "chr"])
def test_brute_force(spark, made, mask, prefix):
    genome, genes, variants = made
    pieces = spark.createDataFrame([(c, k, s[k * WIDTH : (k + 1) * WIDTH]) for c, s in genome.items() for k in range(-(-len(s) // WIDTH))], "chrom string, line long, piece string")
    g = spark.createDataFrame([(x["gene_id"], x["chrom"], x["strand"], x["start"], x["end"]) for x in genes], "gene_id int, chrom string, strand string, start long, end long")
    e = spark.createDataFrame([(x["gene_id"], *ends) for x in genes for ends in x["exons"]], "gene_id int, start long, end long")
    v = spark.createDataFrame([(k, c.replace("chr", prefix), p, r, a) for k, c, p, r, a in variants], "k int, chrom string, pos long, ref string, alt string")
    big, letters = delta.blocks(pieces, WIDTH, 32)
    assert letters == 30 and "".join(r.piece for r in big.filter("chrom = 'chr1'").orderBy("line").collect()) == genome["chr1"]
    got = delta.delta_scores(v, delta.gene_spans(g, e), pieces, WIDTH, delta.motif_scorer(FLANK), REACH, FLANK, mask)
    columns = [x.split()[0] for x in delta.RESULT.split(", ")]
    found = {(r.k, r.gene): tuple(r[c] for c in columns) for r in got.collect()}
    want = {}
    for k, chrom, pos, ref, alt in variants:
        for x in genes:
            if x["chrom"] == chrom and x["start"] <= pos <= x["end"]:
                scored = one(genome, x, pos, ref, alt, mask)
                if scored is not None:
                    want[k, x["gene_id"]] = scored
    assert len(want) > 60 and any(x[0] is None for x in want.values())
    assert found == want


def test_alignment_of_scores():
    y = np.arange(21.0).reshape(7, 3)
    assert delta.aligned(y, 3, 1, 1) is y
    assert delta.aligned(y[:5], 3, 3, 1)[:, 0].tolist() == [0, 3, 6, 9, 0, 0, 12]
    assert delta.aligned(np.vstack([y, y[:2]]), 3, 1, 3)[:, 0].tolist() == [0, 3, 6, 15, 18, 0, 3]


def test_nothing(spark):
    v = spark.createDataFrame([], "chrom string, pos long, ref string, alt string")
    g = spark.createDataFrame([], "gene string, chrom string, strand string, start long, end long, edges array<long>")
    p = spark.createDataFrame([], "chrom string, line long, piece string")
    assert delta.delta_scores(v, g, p, 60, delta.motif_scorer(FLANK), REACH, FLANK).count() == 0
    assert delta.nearest_edge(F.array().cast("array<long>"), F.lit(1)) is not None
