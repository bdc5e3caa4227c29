"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, same_rows

from strandlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    rel = duck.sql(catalogue.oracle_sql()[name])
    same_rows((df.columns, [tuple(r) for r in df.collect()]), (rel.columns, rel.fetchall()))


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF_DIR).count() >= 0
