"""All queries of the library and their SQL for the comparison on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import loop_queries, recording_queries, release_queries, reward_queries, signal_queries, source_queries

MODULES = (reward_queries, signal_queries, loop_queries, source_queries, release_queries, recording_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward report."""
    return QUERIES["reward_report"](spark, sf_dir)
