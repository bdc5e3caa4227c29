"""Sessions with their peaks: in a stream as keyed state with timers, in a batch as windows, with the same rows.

The state of a key is its open sessions, a few rows of a list in the state store. Rows join or bridge them, in any order within
the allowed lateness; a key has one timer, at the end of its first session plus the gap. When the watermark has passed that of
a session no row can join it any more: all such sessions of the key are given out and forgotten in one call, and the timer
goes on to the next one, so the state holds what is open and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that such operators need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "user_id long, start timestamp, end timestamp, n long, peak double, peak_at timestamp"
_STATE = "start long, end long, n long, peak double, peak_at long"

Session = tuple[int, int, int, float | None, int | None]


def _joined(a: Session, b: Session) -> Session:
    """Two sessions as one; of equal peaks the earlier one."""
    peaks = [x for x in (a, b) if x[3] is not None]
    best = min(peaks, key=lambda x: (-x[3], x[4]), default=a)
    return min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], best[3], best[4]


def merge(sessions: list[Session], gap: int) -> list[Session]:
    """Sessions in order, those less than `gap` apart as one."""
    out: list[Session] = []
    for s in sorted(sessions, key=lambda x: x[:2]):
        if out and s[0] - out[-1][1] < gap:
            out[-1] = _joined(out[-1], s)
        else:
            out.append(s)
    return out


def _of_rows(rows: pd.DataFrame, gap: int) -> list[Session]:
    """The sessions of a batch of rows (ts, value)."""
    rows = rows.assign(us=rows["ts"].astype("datetime64[us]").astype("int64")).sort_values("us", kind="stable")
    at, value = rows["us"].to_numpy(), rows["value"].to_numpy(dtype=float)
    cuts = [0, *(np.flatnonzero(np.diff(at) >= gap) + 1).tolist(), len(at)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        own = value[lo:hi]
        known = not np.isnan(own).all()
        k = lo + int(np.nanargmax(own)) if known else lo
        out.append((int(at[lo]), int(at[hi - 1]), hi - lo, float(value[k]) if known else None, int(at[k]) if known else None))
    return out


class PeakSessions(StatefulProcessor):
    """Keyed by user; gap in microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def _timer(self, session: Session) -> int:
        return -(-(session[1] + self.gap) // 1000)

    def _keep(self, sessions: list[Session], before: list[Session]) -> None:
        """Stores the open sessions in place of those before, and sets the timer to the first one that ends."""
        if sessions:
            self.open.put(sessions)
        elif before:
            self.open.clear()
        wanted, there = ({min(map(self._timer, x))} if x else set() for x in (sessions, before))
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the interface's names
        before = [tuple(s) for s in self.open.get()]
        sessions = before
        for part in rows:
            if len(part):
                sessions = merge(sessions + _of_rows(part, self.gap), self.gap)
        self._keep(sessions, before)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sessions = [tuple(s) for s in self.open.get()]
        over = [s for s in sessions if self._timer(s) <= now]
        left = [s for s in sessions if self._timer(s) > now]
        self._keep(left, sessions)
        if over:
            start, end, n, peak, at = zip(*over, strict=True)
            moment = lambda x: pd.to_datetime(pd.Series(x, dtype="Int64"), unit="us")
            yield pd.DataFrame({"user_id": [key[0]] * len(over), "start": moment(start), "end": moment(end), "n": n, "peak": peak, "peak_at": moment(at)})

    def close(self) -> None:
        pass


def _microseconds(gap: str) -> int:
    return int(pd.Timedelta(gap).total_seconds() * 1_000_000)


def session_peaks(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """OUT of events (user_id, ts, value): sessions of rows less than `gap` apart, their largest value and where it comes first.

    Rows without a user or time are in no session; a null value counts as a row, but never as a peak. A stream drops rows that
    are later than `late`, gives a session once the watermark is `gap` beyond its end, and needs PROVIDER.
    """
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).filter("user_id is not null and ts is not null")
    if events.isStreaming:
        events.sparkSession.conf.set(*PROVIDER)
        keyed = rows.withWatermark("ts", late).groupBy("user_id")
        return keyed.transformWithStateInPandas(PeakSessions(_microseconds(gap)), OUT, "append", "eventTime")
    w = Window.partitionBy("user_id").orderBy("ts")
    apart = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= _microseconds(gap)
    rows = rows.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("long"))
    rows = rows.withColumn("session", F.sum("fresh").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    peak = F.max(F.when(F.col("value").isNotNull(), F.struct("value", (-F.unix_micros("ts")).alias("minus"))))
    out = rows.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), peak.alias("p"))
    return out.select("user_id", "start", "end", "n", F.col("p.value").alias("peak"), F.timestamp_micros(-F.col("p.minus")).alias("peak_at"))
