"""Registry tying each operator to its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewatch.sources.bindings import bind, bind_stream, load, with_views, BASE_TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Attribute access to the base tables and the market-data views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def stream(self, view: str) -> DataFrame:
        return bind_stream(self.spark, self.folder, view)

    def since(self, view: str, since_us: int) -> DataFrame:
        """A view without rows before a time, a bound that reaches the scan."""
        return bind(self.spark, self.folder, view, since_us)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return load(self.spark, self.folder, name)
        return bind(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its comparison SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
