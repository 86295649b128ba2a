"""Table scans, idempotent rollup sink, warehouse reload."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..session import written


def scan(
    spark: SparkSession, path: str, schema, since: str | dt.date | None = None
) -> DataFrame:
    """Parquet scan with the day filter at the source (partition pruning or pushdown)."""
    df = spark.read.schema(schema).parquet(path)
    return df if since is None else df.filter(F.col("day") >= as_date(since))


def bound_query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """SQL with bound parameters (``:name``) over named frames (``{name}``)."""
    return spark.sql(sql, args=params, **tables)


def replace_days(
    rollup: DataFrame, path: str, requested: Iterable[dt.date] | None = None
) -> None:
    """Replace the day partitions present in ``rollup``; days not present stay.

    A requested day that came out empty has its rows removed too: dynamic overwrite only
    replaces partitions it writes, so such a partition is dropped through the file system.
    """
    if requested is not None:
        # computed once: it is both written and compared with the requested days
        rollup = written(rollup, "rollup")
    # rows of a day meet before the write (adaptively split if large): few files per day
    rollup.hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(path)
    if requested is not None:
        stored = rollup.sparkSession.read.schema(rollup.schema).parquet(path)
        stale = (
            stored.select("day")
            .filter(F.col("day").isin(list(requested)))
            .join(rollup.select("day"), "day", "left_anti")
            .distinct()
        )
        drop_days(rollup.sparkSession, path, [r["day"] for r in stale.collect()])


def replace_all(rollup: DataFrame, path: str) -> None:
    """Replace a rollup table by all of its days."""
    rollup.hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("day").parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own; nothing happens if it is absent."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


def drop_days(spark: SparkSession, path: str, days: Iterable[dt.date]) -> None:
    """Remove day partitions of a rollup table (a handful of directories)."""
    for day in days:
        remove(spark, f"{path}/day={day.isoformat()}")


def read_rollup(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# table -> columns that hold time stamps as text
WAREHOUSE_TABLES: dict[str, list[str]] = {
    "articles": ["day", "ingested_at"],
    "topics": ["created_at"],
    "regions": [],
    "entities": ["created_at", "last_seen"],
    "article_topic": ["assigned_at"],
    "article_entity": ["assigned_at"],
}


def with_parsed_times(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text columns among ``columns`` -> timestamps; unreadable text becomes null."""
    types = dict(df.dtypes)
    parsed = {c: F.try_to_timestamp(c) for c in columns if types.get(c) == "string"}
    return df.withColumns(parsed) if parsed else df


def reload_warehouse(
    tables: Mapping[str, DataFrame], target: str,
    registry: Mapping[str, Iterable[str]] = WAREHOUSE_TABLES,
) -> dict[str, str]:
    """Truncate and replace every registered table below ``target``; returns their paths."""
    paths = {}
    for name, columns in registry.items():
        if name in tables:
            paths[name] = f"{target.rstrip('/')}/{name}"
            with_parsed_times(tables[name], columns).write.mode("overwrite").parquet(paths[name])
    return paths
