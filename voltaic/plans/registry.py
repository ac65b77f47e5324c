"""Name -> (query builder, oracle SQL) registry behind ``__spark_entry__.queries()``.

Every builder takes ``(spark, sf_dir)``, reads the driver's tables under ``sf_dir`` and returns a lazy
DataFrame. The oracle, when given, is DuckDB SQL over the same tables, with identical column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco
