"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newswell.plans import article_queries, graph_queries, report_queries, text_queries

MODULES = (article_queries, graph_queries, report_queries, text_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate, categories, score and the best articles of each day, week and month, over whole texts."""
    return article_queries.flagship(spark, sf_dir)
