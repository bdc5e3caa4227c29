"""Peaks of tracks against a scan of the whole track from each peak."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strandlake.operators.peaks import PeakStream, score_peaks


def brute(x, threshold, distance, prominence):
    """(number, value): strict maxima, the higher ones first where they are too close, with bases by scanning both sides."""
    peaks = [i for i in range(1, len(x) - 1) if x[i] >= threshold and x[i - 1] < x[i] > x[i + 1]]
    kept = []
    for i in sorted(peaks, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in kept:
        bases = []
        for step in (-1, 1):
            low, j = x[i], i + step
            while 0 <= j < len(x) and x[j] <= x[i]:
                low, j = min(low, x[j]), j + step
            bases.append(low)
        if x[i] - max(bases) >= prominence:
            out.append((i, x[i]))
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_stream(piece):
    rng = random.Random(piece)
    for _ in range(1500):
        x = [float(rng.choice([0, 1, 2, 3, 4, 5, 5, 6])) for _ in range(rng.randint(0, 30))]
        how = (rng.choice([0, 2, 4]), rng.randint(1, 6), rng.choice([0, 1, 2, 3]))
        stream, got = PeakStream(*how), []
        for k in range(0, len(x), piece):
            got += stream.feed(np.arange(k, min(len(x), k + piece)), np.array(x[k : k + piece]))
        got += stream.end()
        assert sorted(got) == brute(x, *how)
        assert not stream.places and not stream.kept and not stream.enough


def test_what_is_kept_is_bounded():
    """A million values: neither the track nor settled peaks are held."""
    x = np.random.default_rng(1).random(1_000_000)
    stream, n, most = PeakStream(0.5, 10, 0.1), 0, 0
    for k in range(0, len(x), 10_000):
        n += len(stream.feed(np.arange(k, k + 10_000), x[k : k + 10_000]))
        most = max(most, len(stream.stack) + len(stream.places) + len(stream.run))
    assert n > 50_000 and most < 10_000


def test_tracks_of_a_table(spark):
    rng = random.Random(2)
    tracks = {k: [round(rng.random(), 1) for _ in range(rng.choice([0, 1, 2, 3, 400]))] for k in range(30)}
    rows = [(k, "a", 3 * i, v) for k, x in tracks.items() for i, v in enumerate(x)] + [(None, "b", 5, 1.0), (2, "a", 100_000, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g long, s string, position long, score double")
    got = sorted((r.g, r.position // 3, r.score) for r in score_peaks(frame, ["g", "s"], distance=4, prominence=0.2).collect())
    assert got == sorted((k, *p) for k, x in tracks.items() for p in brute(x, 0.5, 4, 0.2))
    assert score_peaks(frame.limit(0), ["g", "s"]).count() == 0
