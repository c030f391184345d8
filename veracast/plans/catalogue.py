"""All queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veracast.plans import feature_queries, other_queries, tabular_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL = tabular_queries.QUERIES | feature_queries.QUERIES | other_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
