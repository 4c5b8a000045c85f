"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lattice_queries, model_queries, score_queries, spatial_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (lattice_queries, score_queries, spatial_queries, model_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
