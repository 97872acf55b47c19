"""Queries and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Collects functions ``f(spark, table)``; ``table(name)`` reads one of the given tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(function: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return function(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            self.queries[function.__name__] = run
            if sql:
                self.oracle[function.__name__] = sql.strip()
            return function

        return add
