"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strandlake.session import session

    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(x):
    """A value that compares equal in both engines."""
    import datetime
    import decimal
    import math

    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6) + 0.0
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def same_rows(got, want) -> None:
    """Two frames (columns, list of rows) have the same columns and the same rows, in any order."""
    (gc, gr), (wc, wr) = got, want
    assert sorted(gc) == sorted(wc)
    order = sorted(gc)
    a = sorted((tuple(plain(r[gc.index(c)]) for c in order) for r in gr), key=repr)
    b = sorted((tuple(plain(r[wc.index(c)]) for c in order) for r in wr), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
