"""All queries outside the optional subpackages, by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweave.plans import build_queries, graph_queries, keyed_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (graph_queries, build_queries, keyed_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return graph_queries.QUERIES["hotspot_files"](spark, root)
