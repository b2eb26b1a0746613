"""All queries of the core, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benchsieve.plans import audit_queries, stats_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**audit_queries.QUERIES, **stats_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**audit_queries.SQL, **stats_queries.SQL}
