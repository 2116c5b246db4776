"""The query catalogue of the core: name -> callable(spark, sf_dir), and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import fact_queries, pipeline, stream_queries, text_queries, unit_queries

MODULES = [unit_queries, text_queries, fact_queries, stream_queries, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
