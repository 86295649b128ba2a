"""Report files: daily signal CSV, dashboard export, text reports, daily payload."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.dates import as_date, days_before
from ..operators import listing

BOM = "﻿"


def signal_rows(articles: DataFrame) -> DataFrame:
    """Risk and opportunity articles as the daily CSV lists them, not yet ordered."""
    return listing.signals(articles).select(
        "id", "day", "source", "title", F.array_join("topics", ",").alias("topics"),
        text.signal_kind().alias("kind"), "score",
    )


def _write_csv_days(rows: DataFrame, path: str, headers: dict[str, str], unit: str = "day") -> None:
    """CSV files with header, one folder ``of_day=`` for each day (or first day of a longer unit), each
    file from the newest day to the oldest, then by id.

    The rows of a day meet by one shuffle, which the adaptive planner splits where a day is large;
    each file is sorted by itself. There is no total sort, whose sampling would compute the rows
    twice: the folders are read from the last to the first.
    """
    of_day = F.col("day") if unit == "day" else F.to_date(F.trunc("day", unit))
    placed = rows.withColumn("of_day", of_day).hint("rebalance", "of_day")
    sorted_rows = placed.sortWithinPartitions("of_day", F.desc("day"), "id")
    named = sorted_rows.select(*[F.col(c).alias(h) for c, h in headers.items()], "of_day")
    named.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("of_day").csv(path)


def write_signal_csv(articles: DataFrame, path: str) -> None:
    """The mark in the first header cell makes spreadsheets read UTF-8."""
    names = ["day", "source", "title", "topics", "kind", "score"]
    _write_csv_days(signal_rows(articles), path, {n: BOM + n if n == "day" else n for n in names})


def read_signal_csv(spark: SparkSession, *paths: str) -> DataFrame:
    schema = "day DATE, source STRING, title STRING, topics STRING, kind STRING, score INT"
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    rows = reader.option("multiLine", True).option("escape", '"').csv(list(paths))
    return rows.select("day", "source", "title", "topics", "kind", "score")


def dashboard_rows(exported: DataFrame) -> DataFrame:
    """Exported articles with their name lists as comma text."""
    return exported.withColumns(
        {c: F.array_join(c, ",") for c in ("persons", "orgs", "places")}
    )


def write_dashboard_csv(exported: DataFrame, path: str, unit: str = "day") -> None:
    _write_csv_days(dashboard_rows(exported), path, {f.name: f.name for f in schemas.DASHBOARD_CSV}, unit)


def read_dashboard_csv(spark: SparkSession, *paths: str) -> DataFrame:
    reader = spark.read.schema(schemas.DASHBOARD_CSV).option("header", True)
    rows = reader.option("multiLine", True).option("escape", '"').csv(list(paths))
    return rows.select(*schemas.DASHBOARD_CSV.fieldNames())


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Text reports named ``<anything>_<yyyy-mm-dd>.txt``, or any text file in a folder that ends with
    the date, -> (day, text)."""
    files = spark.read.text(path, wholetext=True)
    dated = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})(?:\.txt|/[^/]*\.txt)$", 1)
    day = F.try_to_date(dated, "yyyy-MM-dd")
    return files.select(day.alias("day"), F.col("value").alias("text")).filter("day is not null")


def read_payload(spark: SparkSession, *paths: str) -> DataFrame:
    """(day, payload) of written payloads; the day is in the folder name and in the document."""
    rows = spark.read.schema("value STRING").text(list(paths))
    day = F.to_date(F.get_json_object("value", "$.day"))
    return rows.select(day.alias("day"), F.col("value").alias("payload"))


def report_of(reports: DataFrame, day: str | dt.date) -> DataFrame:
    return reports.filter(F.col("day") == as_date(day))


def latest_report(reports: DataFrame, as_of: str | dt.date, days: int = 4) -> DataFrame:
    """Newest report of the last ``days`` days, empty if there is none."""
    recent = reports.filter(
        F.col("day").between(days_before(as_of, days - 1), as_date(as_of))
    )
    return recent.orderBy(F.desc("day")).limit(1)


def write_payload(payload: DataFrame, path: str) -> None:
    """One JSON document per day, replaced per day."""
    payload.select("day", "payload").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").text(path)
