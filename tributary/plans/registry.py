"""Every registered query and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engine_queries, extraction_queries, relational_queries, similarity_queries, storage_queries, text_queries, tree_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (similarity_queries, engine_queries, relational_queries, storage_queries, text_queries, extraction_queries, tree_queries)


def queries() -> dict[str, Query]:
    return {name: f for module in _MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
