"""A registry of (query, oracle) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table


class Tables:
    """The tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Book:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None):
        """Register f(t: Tables) under its name."""

        def add(f):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add
