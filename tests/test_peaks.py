"""Sessions with peaks: the stream equals the batch, also over restarts, late rows and bridges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from strandlake.streaming import events, peaks

SCHEMA = "user_id long, ts timestamp, value double"
DAY = datetime(2024, 5, 1)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, check, late="3 hours"):
    stream = peaks.session_peaks(events.read_events(spark, folder), "1 hour", late)
    events.to_table(stream, out, check).awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(peaks.OUT).parquet(out).collect())


def made(n, seed):
    """Files of rows in order of time, those of a file shuffled, some of them an hour or two behind."""
    rng = random.Random(seed)
    at, files = DAY, []
    for _ in range(n):
        rows = []
        for _ in range(rng.randint(5, 30)):
            at += timedelta(minutes=rng.choice([0, 1, 10, 30, 61, 150]))
            rows.append((rng.randint(1, 3), at - timedelta(minutes=rng.choice([0, 0, 5, 55, 120])), rng.choice([None, 1.0, 2.0, 2.0, 5.5])))
        rng.shuffle(rows)
        files.append(rows)
    return files


def test_merge_and_peaks():
    assert peaks.merge([(0, 5, 2, 1.0, 0), (14, 20, 1, 3.0, 15), (30, 31, 1, None, None)], 10) == [(0, 20, 3, 3.0, 15), (30, 31, 1, None, None)]
    assert peaks.merge([(0, 5, 1, 2.0, 5), (6, 9, 1, 2.0, 7), (7, 8, 1, None, None)], 10) == [(0, 9, 3, 2.0, 5)]
    assert peaks.merge([], 10) == []


@pytest.mark.parametrize("stop", [2, 5])
def test_stream_equals_batch_over_a_restart(spark, tmp_path, stop):
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    files = made(6, stop)
    for rows in files[:stop]:
        put(spark, folder, rows)
    early = run(spark, folder, out, check)
    for rows in [*files[stop:], [(9, DAY + timedelta(days=400), 0.0)]]:
        put(spark, folder, rows)
    got = run(spark, folder, out, check)
    rows = [r for f in files for r in f]
    want = sorted(tuple(r) for r in peaks.session_peaks(spark.createDataFrame(rows, SCHEMA), "1 hour").collect())
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert set(early) <= set(got) and len(early) < len(got)
    assert run(spark, folder, out, check) == got  # nothing comes twice


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    put(spark, folder, [(1, DAY, 1.0)])
    put(spark, folder, [(2, DAY + timedelta(days=3), 1.0)])
    run(spark, folder, out, check, "1 hour")
    put(spark, folder, [(1, DAY + timedelta(minutes=5), 9.0), (2, DAY + timedelta(days=9), 1.0)])
    assert [r[:1] + r[3:5] for r in run(spark, folder, out, check, "1 hour")] == [(1, 1, 1.0), (2, 1, 1.0)]


def test_batch_of_nulls(spark):
    rows = [(1, DAY, None), (1, DAY, None), (None, DAY, 1.0), (2, None, 1.0)]
    assert [tuple(r) for r in peaks.session_peaks(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, DAY, DAY, 2, None, None)]
    assert peaks.session_peaks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_key_has_one_timer_and_one_expiry(spark, tmp_path, monkeypatch):
    """All sessions that the watermark has passed go in one call; the next one's timer is set."""

    class Handle:
        def __init__(self):
            self.rows, self.timers, self.put_calls = [], set(), 0

        def getListState(self, *_):  # noqa: N802
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def registerTimer(self, t):  # noqa: N802
            self.timers.add(t)

        def deleteTimer(self, t):  # noqa: N802
            self.timers.remove(t)

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms  # noqa: N815

    import pandas as pd

    handle, hour = Handle(), 3_600_000
    of = peaks.PeakSessions(hour * 1000)
    of.init(handle)
    starts = [DAY + timedelta(hours=3 * k) for k in range(50)]
    list(of.handleInputRows((1,), iter([pd.DataFrame({"ts": starts, "value": 1.0})]), Now(0)))
    first = int((DAY - datetime(1970, 1, 1)).total_seconds() * 1000) + hour
    assert handle.timers == {first} and len(handle.rows) == 50
    handle.timers.clear()  # the engine forgets a timer before it calls
    handle.timers.add(first)
    late = Now(first + 40 * 3 * hour)
    out = pd.concat(of.handleExpiredTimer((1,), late, Now(first)))
    assert len(out) == 41 and len(handle.rows) == 9
    assert handle.timers == {first + 41 * 3 * hour}
