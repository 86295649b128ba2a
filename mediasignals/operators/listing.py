"""Row-level filters, listings and pages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text
from ..functions.dates import as_date, date_range

SIGNAL_FILTERS = {
    "riesgo": "risk = 1", "oportunidad": "opportunity = 1", "relevante": "relevant = 1",
}
MAX_PAGE = 200


def source_contains(df: DataFrame, part: str) -> DataFrame:
    """Case-insensitive 'contains' on the source name; % and _ in ``part`` are wildcards."""
    return df.filter(F.col("source").ilike(f"%{part}%"))


def filtered(
    articles: DataFrame,
    day: str | dt.date | None = None,
    source: str | None = None,
    signal: str | None = None,
) -> DataFrame:
    if day is not None:
        articles = articles.filter(F.col("day") == as_date(day))
    if source:
        articles = source_contains(articles, source)
    if signal in SIGNAL_FILTERS:
        articles = articles.filter(SIGNAL_FILTERS[signal])
    return articles


def page(
    articles: DataFrame,
    day: str | dt.date | None = None,
    source: str | None = None,
    signal: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """One page of matching articles, newest first, each row with the ``total`` of matches."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be 1..200 and offset >= 0")
    matches = filtered(articles, day, source, signal)
    total = matches.agg(F.count("*").alias("total"))
    rows = matches.select(
        "id", "title", "day", "source", "url", "topics",
        F.coalesce("risk", F.lit(0)).alias("risk"),
        F.coalesce("opportunity", F.lit(0)).alias("opportunity"),
        "geo_level",
    )
    chosen = rows.orderBy(F.desc("day"), F.desc("id")).offset(offset).limit(limit)
    return chosen.select("*", total.scalar().alias("total"))


def signals(articles: DataFrame) -> DataFrame:
    return articles.filter("risk = 1 or opportunity = 1")


def relevant(articles: DataFrame) -> DataFrame:
    return articles.filter("relevant = 1")


def with_kind(articles: DataFrame) -> DataFrame:
    return articles.withColumn("kind", text.signal_kind())


def chosen(
    articles: DataFrame,
    kinds: Sequence[str] | None = None,
    levels: Sequence[str] | None = None,
    deep_only: bool = False,
) -> DataFrame:
    """Multi-select filters over rows with ``kind``; an empty selection filters nothing."""
    if kinds:
        articles = articles.filter(F.col("kind").isin(list(kinds)))
    if levels:
        articles = articles.filter(F.col("geo_level").isin(list(levels)))
    if deep_only:
        articles = articles.filter("deep_analysis = 1")
    return articles


def risk_rows(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("kind").isin("RIESGO", "MIXTO"))


def opportunity_rows(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("kind").isin("OPORTUNIDAD", "MIXTO"))


def deep_rows(articles: DataFrame) -> DataFrame:
    return articles.filter("deep_analysis = 1")


def active_topics(topics: DataFrame) -> DataFrame:
    return topics.filter("active = 1").orderBy("name")


def selectable_entities(entities: DataFrame, limit: int = 100) -> DataFrame:
    """Key entities first, then by name."""
    return entities.orderBy(F.desc("is_key"), "name", "id").limit(limit)


def latest(
    articles: DataFrame,
    start: str | dt.date,
    end: str | dt.date,
    level: str = "all",
    limit: int = 500,
) -> DataFrame:
    """Newest rows of a range with their kind."""
    rows = date_range(articles, start, end)
    if level and level != "all":
        rows = rows.filter(F.col("geo_level") == level)
    newest = rows.orderBy(F.desc("day"), F.desc("id")).limit(limit)
    flags = {f: F.coalesce(f, F.lit(0)) for f in ("risk", "opportunity")}
    return with_kind(newest.withColumns(flags))


def table_view(articles: DataFrame) -> DataFrame:
    """Columns of the news table: text date, markdown link."""
    link = F.when(
        F.coalesce("url", F.lit("")) != "", F.concat(F.lit("[Ver]("), "url", F.lit(")"))
    ).otherwise("")
    return articles.select(
        "id",
        F.date_format("day", "yyyy-MM-dd").alias("day_text"),
        text.signal_kind().alias("kind"),
        "source", "title", link.alias("link"), "geo_level",
    )


def risks_to_analyse(articles: DataFrame, day: str | dt.date) -> DataFrame:
    wanted = (F.col("risk") == 1) & (F.col("deep_analysis") == 1) & (F.col("day") == as_date(day))
    return articles.filter(wanted).select("id", "title", "source", "url")


def highlighted(articles: DataFrame, day: str | dt.date, limit: int = 3) -> DataFrame:
    """Relevant articles of a day with the highest scores."""
    of_day = articles.filter((F.col("relevant") == 1) & (F.col("day") == as_date(day)))
    top = of_day.orderBy(F.desc("score"), "id").limit(limit)
    return top.select("id", *highlight_columns())


def highlight_columns() -> list:
    topics = F.nullif(F.array_join("topics", ","), F.lit(""))
    level = F.nullif("geo_level", F.lit(""))
    return [
        F.col("title"), F.col("source"),
        F.coalesce(topics, F.lit(lexicon.NO_TOPIC)).alias("topic"),
        text.signal_kind().alias("kind"),
        F.coalesce(level, F.lit(lexicon.DEFAULT_REGION)).alias("region"),
        F.coalesce("url", F.lit("")).alias("url"),
    ]
