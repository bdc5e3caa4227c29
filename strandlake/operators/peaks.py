"""Peaks of tracks with a least distance and prominence, read as a stream.

A peak's prominence is its height above the higher of its two bases: the lowest values between it and the next higher value on
either side. A stack of falling maxima, with the lowest value between each two, has the left base when a maximum comes in and the
right base when a higher one takes it off, so a track is read once. Peaks compete for distance only within runs that are
closer than it. What is kept of a track is that stack and the last run, not the track.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_NONE = float("inf")


class PeakStream:
    """One track: feed its places and values piece by piece, then end it; both give (place, value) of peaks that are settled."""

    def __init__(self, threshold: float, distance: int, prominence: float):
        self.threshold, self.distance, self.prominence = threshold, distance, prominence
        self.x, self.at = np.zeros(0), np.zeros(0, np.int64)  # the last value, not yet judged, after the one before it
        self.seen = 0  # values before these
        self.valley = _NONE
        self.stack: list[tuple[float, int, float, float]] = []  # height, number (-1: no peak), lowest before it on the stack, left base
        self.run: list[tuple[int, float]] = []  # (number, height) of peaks that compete
        self.places: dict[int, int] = {}  # of peaks that are not settled
        self.kept: dict[int, bool] = {}
        self.enough: dict[int, tuple[bool, float]] = {}

    def feed(self, at: np.ndarray, x: np.ndarray) -> list[tuple[int, float]]:
        at, x = np.concatenate((self.at, at)), np.concatenate((self.x, x))
        begin = 1 if self.seen or len(self.x) == 2 else 0
        n = len(x)
        if n < 2:
            self.at, self.x = at, x
            return []
        left = np.concatenate(([-_NONE], x[:-1]))[begin : n - 1]
        own, right = x[begin : n - 1], x[begin + 1 :]
        top = np.flatnonzero((left <= own) & (own >= right))
        peak = (left < own) & (own > right) & (own >= self.threshold) & (left > -_NONE)
        out: list[tuple[int, float]] = []
        if len(top):
            lows = np.minimum.reduceat(own, np.concatenate(([0], top)))[: len(top)] if top[0] else np.minimum.reduceat(own, top)
            # lows[j]: from the maximum before (or the piece's first value) up to maximum j
            between = np.minimum(lows, own[top]) if top[0] else np.concatenate(([own[0]], np.minimum(lows[:-1], own[top[1:]])))
            for j, k in enumerate(top.tolist()):
                low = float(between[j]) if j else min(self.valley, float(between[0]))
                number = self.seen + begin + k
                if peak[k]:
                    self.places[number] = int(at[begin + k])
                out += self._maximum(float(own[k]), number if peak[k] else -1, low)
            self.valley = float(own[top[-1] :].min())
        elif len(own):
            self.valley = min(self.valley, float(own.min()))
        keep = 2 if n >= 2 else 1
        self.seen += n - keep
        self.at, self.x = at[-keep:], x[-keep:]
        return out

    def _maximum(self, height: float, number: int, low: float) -> list[tuple[int, float]]:
        out = []
        while self.stack and self.stack[-1][0] < height:
            e = self.stack.pop()
            out += self._based(e, low)
            low = min(low, e[2])
        left = min(low, self.stack[-1][3]) if self.stack and self.stack[-1][0] == height else low
        self.stack.append((height, number, low, left))
        if number >= 0:
            if self.run and number - self.run[-1][0] >= self.distance:
                out += self._thinned()
            self.run.append((number, height))
        return out

    def _based(self, e: tuple[float, int, float, float], right: float) -> list[tuple[int, float]]:
        height, number, _, left = e
        if number < 0:
            return []
        self.enough[number] = (height - max(left, right) >= self.prominence, height)
        return self._settled(number)

    def _thinned(self) -> list[tuple[int, float]]:
        """Of the run the higher ones stay first, the earlier of equal ones."""
        held: list[int] = []
        for number, _ in sorted(self.run, key=lambda r: (-r[1], r[0])):
            k = bisect_right(held, number)
            self.kept[number] = all(abs(number - j) >= self.distance for j in held[max(0, k - 1) : k + 1])
            if self.kept[number]:
                held.insert(k, number)
        done = [number for number, _ in self.run]
        self.run = []
        return [x for number in done for x in self._settled(number)]

    def _settled(self, number: int) -> list[tuple[int, float]]:
        if number not in self.kept or number not in self.enough:
            return []
        place, stays, (enough, height) = self.places.pop(number), self.kept.pop(number), self.enough.pop(number)
        return [(place, height)] if stays and enough else []

    def end(self) -> list[tuple[int, float]]:
        out = []
        if len(self.x) and (len(self.x) == 1 or self.x[-2] <= self.x[-1]):
            out += self._maximum(float(self.x[-1]), -1, min(self.valley, float(self.x[-1])))
            low = _NONE
        else:
            low = min(self.valley, float(self.x[-1])) if len(self.x) else _NONE
        out += self._thinned()
        while self.stack:
            e = self.stack.pop()
            out += self._based(e, low)
            low = min(low, e[2])
        return out


def score_peaks(rows: DataFrame, by: Sequence[str], score: str = "score", threshold: float = 0.5, distance: int = 10, prominence: float = 0.1) -> DataFrame:
    """(by, position, score): strict local maxima from a threshold up, thinned to a distance in rows (higher ones first), with a least prominence.

    Rows without a score are not part of a track. A track is read in order by one task, in pieces.
    """
    n = len(by)
    schema = StructType([*rows.select(*by).schema.fields, *StructType.fromDDL("position long, score double").fields])
    arrow = to_arrow_schema(schema)
    track = rows.filter(F.col(score).isNotNull()).select(*by, F.col("position").cast("long").alias("position"), F.col(score).cast("double").alias("score"))
    dealt = track.repartition(*by).sortWithinPartitions(*by, "position")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stream = None, None

        def table(found: list[tuple[int, float]]) -> pa.RecordBatch:
            columns = [*([k] * len(found) for k in key), *(zip(*found, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            keys = [batch.column(c) for c in range(n)]
            change = np.zeros(m, bool)
            for c in keys:
                values = c.to_pylist()
                change[1:] |= np.fromiter((a != b for a, b in zip(values, values[1:], strict=False)), bool, m - 1)
            edges = [0, *np.flatnonzero(change).tolist(), m]
            at, x = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            for lo, hi in zip(edges, edges[1:], strict=False):
                now = tuple(c[lo].as_py() for c in keys)
                if stream is None or now != key:
                    if stream is not None and (found := stream.end()):
                        yield table(found)
                    key, stream = now, PeakStream(threshold, distance, prominence)
                if found := stream.feed(at[lo:hi], x[lo:hi]):
                    yield table(found)
        if stream is not None and (found := stream.end()):
            yield table(found)

    return dealt.mapInArrow(scan, schema)
