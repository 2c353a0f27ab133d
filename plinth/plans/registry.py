"""Where plans register, and how they read tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers plan(t: Tables) under its name."""

    def add(plan):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(Tables(spark, folder))

        run.__doc__ = plan.__doc__
        QUERIES[plan.__name__] = run
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return add
