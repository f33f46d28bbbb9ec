"""All registered queries and the SQL that they are held against, by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import corpus_queries, file_stream_queries, more_queries, relational_queries, retrieval_queries, stats_queries, text_queries

MODULES = [stats_queries, relational_queries, text_queries, retrieval_queries, corpus_queries, file_stream_queries, more_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.oracle_sql().items()}
