"""Registry of queries over the shared tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import table, view


@dataclass(frozen=True)
class Source:
    """Tables and views of one folder."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        from .views import VIEWS

        return view(self.spark, self.sf_dir, name) if name in VIEWS else table(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a Source as a query; sql is its DuckDB twin."""

    def put(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return put
