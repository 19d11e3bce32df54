"""Registry of runnable queries and, where SQL can say it, the equivalent ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradus.plans import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of one scale-factor folder, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in standins.VIEWS:
            return standins.VIEWS[name](self)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under an operator id.

    ``uses`` lists stand-in views; their SQL definitions are prepended as CTEs.
    """

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = standins.with_views(sql, uses)
        return fn

    return wrap
