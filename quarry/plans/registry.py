"""All library queries, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

from quarry.plans import content, files, graphs, ranking, relational, search

_MODULES: tuple = (ranking, graphs, content, files, relational, search)


def queries() -> dict[str, Query]:
    return {name: q for module in _MODULES for name, (q, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
