"""The registered queries of the core and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstrata.plans import comparison, content, profile, retrieval, versions  # noqa: F401  (they register their queries)
from docstrata.plans.register import QUERIES, SQL


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return retrieval.rrf_hybrid(spark, directory)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
