"""Named queries over the given tables, each with its SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lokora.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in SQL on the same tables."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register
