"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import crawl_queries as _c
from . import page_queries as _p
from . import url_queries as _u

_MODULES = [_u, _p, _c]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _u.url_fields(spark, sf_dir).groupBy("field", "value").count()
