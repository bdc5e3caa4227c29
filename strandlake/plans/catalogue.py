"""All queries by name, with the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import columns, domain, files, further, genome, ordered, relations
from .registry import ORACLES, QUERIES, Query
from .views import Views

_FAMILIES = (columns, relations, ordered, domain, further, files, genome)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.flagship(Views(spark, sf_dir))
