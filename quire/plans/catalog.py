"""The registry of the core's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import hierarchies, ingesting, libraries, searching, taxonomies, working

MODULES = (hierarchies, libraries, searching, ingesting, taxonomies, working)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that ``entry`` runs."""
    return searching.fts_documents(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
