"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylag.functions.numeric import round_doubles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 6) -> Callable[[Query], Query]:
    """Register a query. Its floating columns are rounded as they are in the SQL, or
    left alone with digits=None where all of them are exact."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(spark, sf_dir)
            return result if digits is None else round_doubles(result, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add
