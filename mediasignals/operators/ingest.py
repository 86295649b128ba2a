"""Landed feed entries -> article rows, first row per URL wins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text


def article_rows(entries: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Entries (source, seq, title, link, summary, description, published) -> article rows.

    Rows without title or link are dropped; the summary is preferred to the description;
    an unreadable date becomes ``as_of``.
    """
    rows = entries.select(
        "seq",
        text.strip_space("title").alias("title"),
        F.coalesce(F.nullif("summary", F.lit("")), "description", F.lit("")).alias("description"),
        text.strip_space("link").alias("url"),
        dates.feed_day("published", as_of).alias("day"),
        "source",
    )
    return rows.filter((F.col("title") != "") & (F.col("url") != ""))


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key. Each map task keeps one row per key before the shuffle, so a
    key with a third of all rows sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def new_articles(rows: DataFrame, stored: DataFrame | None, order: str = "seq") -> DataFrame:
    """Insert-or-ignore on URL: first row inside the batch, none that is stored already."""
    fresh = rows
    if stored is not None:
        fresh = fresh.join(stored.select("url"), "url", "left_anti")
    return first_per_key(fresh, ["url"], [order])


def with_ids(rows: DataFrame) -> DataFrame:
    """Row id from the URL: stable across reruns and computed without any ordering."""
    return rows.withColumn("id", F.xxhash64("url"))


def pending_topics(articles: DataFrame, classified: DataFrame) -> DataFrame:
    """Articles without a topic classification yet (``classified`` holds their ids)."""
    return articles.join(classified.select("id"), "id", "left_anti")


def pending_signals(articles: DataFrame, evaluated: DataFrame) -> DataFrame:
    relevant = articles.filter("relevant = 1")
    return relevant.join(evaluated.select("id"), "id", "left_anti")


def pending_flag(articles: DataFrame, flag: str) -> DataFrame:
    """Flag form of the same filter: 0 or null means pending."""
    return articles.filter(F.coalesce(F.col(flag), F.lit(0)) == 0)


def pending_entities(articles: DataFrame, extracted: DataFrame, max_per_run: int) -> DataFrame:
    """Newest relevant articles without entities, at most ``max_per_run`` per run."""
    waiting = articles.filter("relevant = 1").join(extracted.select("id"), "id", "left_anti")
    return waiting.orderBy(F.desc("day"), "id").limit(max_per_run)


def stage_status(articles: DataFrame) -> DataFrame:
    """Which stages have already touched a row, derived from its columns."""
    return articles.select(
        "*",
        F.col("topics").isNotNull().cast("int").alias("topics_done"),
        F.col("persons").isNotNull().cast("int").alias("entities_done"),
        F.col("relevant").isNotNull().cast("int").alias("signals_done"),
    )
