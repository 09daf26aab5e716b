"""All named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placelore.plans import oracle_base, oracle_eval, oracle_memory, queries_base, queries_eval, queries_memory

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**queries_base.QUERIES, **queries_eval.QUERIES, **queries_memory.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracle_base.ORACLE, **oracle_eval.ORACLE, **oracle_memory.ORACLE}
