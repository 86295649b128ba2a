"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

Build = Callable[[Tables], DataFrame]

QUERIES: dict[str, Build] = {}
CHECKS: dict[str, str] = {}

# named queries shared by several checks
SHARED: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``check`` is SQL over tables, views and ``SHARED`` queries."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return register


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__name__ = name
    return run


def check_sql(name: str) -> str:
    return with_views(CHECKS[name], SHARED)
