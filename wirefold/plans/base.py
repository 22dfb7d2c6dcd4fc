"""Registration of queries: a DataFrame function and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.adapters import Tables
from . import oracle

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR
MINUTE = 60_000_000


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(tables)`` as a query; ``sql`` may name the adapter views."""

    def put(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle.sql(sql, views)
        return fn

    return put
