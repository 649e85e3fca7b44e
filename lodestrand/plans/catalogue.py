"""All queries over the operators of the core, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import evaluation, quality, retrieval, streams

MODULES = (retrieval, evaluation, quality, streams)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Every query of the core by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: text for module in MODULES for name, text in module.SQL.items()}
