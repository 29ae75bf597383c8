"""All queries over graph, text and files by name, and their DuckDB versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import answer_queries, graph_queries, index_queries, source_queries, text_queries, upkeep_queries  # noqa: F401  they register themselves
from graphloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of two nations reaches."""
    return QUERIES["impact_upstream"](spark, sf_dir)
