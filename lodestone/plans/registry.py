"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Family:
    """Queries of one module. ``@family.query(sql)`` registers a function of :class:`Tables` by its name."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.ORACLES[f.__name__] = sql
            return f

        return add
