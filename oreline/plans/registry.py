"""Registry of named queries, each next to its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one directory by name, scanned where they are used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query; ``sql`` gives the same rows in DuckDB."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return build

    return register


def cents(column: str):
    """Money as whole cents, so that sums are exact in any order."""
    return F.round(F.col(column) * 100).cast("long")


def day(column: str):
    return F.col(column).cast("date")


def text_day(column):
    return (F.col(column) if isinstance(column, str) else column).cast("date").cast("string")
