"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenlake.sources.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables and the views over them: ``t.boxes``."""

    def __init__(self, spark: SparkSession, sf_dir: str, in_buckets: bool = False):
        self.spark, self.sf_dir, self.in_buckets = spark, sf_dir, in_buckets

    @property
    def dealt(self) -> Tables:
        """The same tables; views that are written in buckets of the image are dealt by it."""
        return Tables(self.spark, self.sf_dir, True)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.in_buckets)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register
