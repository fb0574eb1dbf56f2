"""All queries by name, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinspark.plans import aggregates, bedside, care, clinical, generation, history, lexicons, ordered, registry, sheets, text

_MODULES = (aggregates, ordered, text, clinical, registry, history, sheets, bedside, lexicons, generation, care)


def document_quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.document_quality_profile(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
