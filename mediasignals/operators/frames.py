"""Dashboard and weekly report figures computed from exported article rows.

Rows carry ``topics``, ``persons``, ``orgs`` and ``places`` as arrays and their ``kind``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import as_date, last_days, lenient_date
from .geo import subregion_order, with_subregion


def parse_dashboard_csv(raw: DataFrame) -> DataFrame:
    """Lenient typing of exported text rows: bad date -> null, bad number -> 0, null -> ''."""
    def number(c: str) -> Column:
        return F.coalesce(F.expr(f"try_cast(try_cast({c} as double) as int)"), F.lit(0)).alias(c)

    words = ["source", "title", "url", "persons", "orgs", "places", "geo_level", "topics"]
    typed = raw.select(
        F.expr("try_cast(id as bigint)").alias("id"),
        lenient_date("day").alias("day"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in words],
        *[number(c) for c in ("deep_analysis", "risk", "opportunity")],
    )
    return typed.withColumn("kind", text.signal_kind())


def list_columns(rows: DataFrame) -> DataFrame:
    """Text lists of the export -> arrays: topics by '|', names by ','."""
    return rows.withColumns(
        {
            "topics": text.split_list("topics", "|"),
            **{c: text.split_list(c) for c in ("persons", "orgs", "places")},
        }
    )


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def _volume(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.sum("risk").alias("risks"),
        F.sum("opportunity").alias("opportunities"),
    )


def volume_by_day(rows: DataFrame, as_of: str | dt.date, days: int = 30) -> DataFrame:
    return _volume(last_days(rows, as_of, days), "day").orderBy("day")


def volume_by_source(rows: DataFrame, as_of: str | dt.date, days: int = 30) -> DataFrame:
    return _volume(last_days(rows, as_of, days), "source").orderBy(F.desc("total"), "source")


def volume_by_level(rows: DataFrame) -> DataFrame:
    return _volume(rows, "geo_level").orderBy(F.desc("total"), "geo_level")


def exploded_topics(rows: DataFrame, *columns: str) -> DataFrame:
    one = rows.select(*columns, F.explode("topics").alias("topic"))
    return one.withColumn("topic", text.strip_space("topic")).filter("topic <> ''")


def topic_day_pivot(
    rows: DataFrame, topics: Sequence[str], as_of: str | dt.date, days: int = 30
) -> DataFrame:
    """Days x topics with zeros. The topic list is given, so no pass is spent on finding it."""
    hits = exploded_topics(last_days(rows, as_of, days), "day")
    wide = hits.groupBy("day").pivot("topic", list(topics)).agg(F.count(F.lit(1)))
    return wide.na.fill(0).orderBy("day")


def name_counts(
    rows: DataFrame, as_of: str | dt.date, days: int = 30, limit: int = 20
) -> DataFrame:
    """Persons and organisations with mentions, risk and opportunity mentions."""
    names = last_days(rows, as_of, days).select(
        F.explode(F.concat("persons", "orgs")).alias("entity"), "risk", "opportunity"
    )
    names = names.withColumn("entity", text.strip_space("entity")).filter("entity <> ''")
    counted = names.groupBy("entity").agg(
        F.count("*").alias("mentions"),
        F.count_if(F.col("risk") == 1).alias("risks"),
        F.count_if(F.col("opportunity") == 1).alias("opportunities"),
    )
    return counted.orderBy(F.desc("mentions"), "entity").limit(limit)


def place_counts(rows: DataFrame, limit: int = 20) -> DataFrame:
    places = (
        rows.select(F.explode("places").alias("place"))
        .withColumn("place", text.strip_space("place"))
        .filter("place <> ''")
    )
    counted = places.groupBy("place").agg(F.count("*").alias("mentions"))
    return counted.orderBy(F.desc("mentions"), "place").limit(limit)


# --- weekly report --------------------------------------------------------------------


def week_rows(rows: DataFrame, end: str | dt.date | None = None) -> DataFrame:
    """The seven days through ``end``; by default through the last day with data."""
    if end is None:
        last = rows.agg(F.max("day").alias("last")).scalar()
    else:
        last = as_date(end)
    return rows.filter(F.col("day").between(F.date_sub(last, 6), last))


def weekly_kpis(week: DataFrame) -> DataFrame:
    return week.agg(
        F.count("*").alias("n_articles"),
        F.coalesce(F.sum("risk"), F.lit(0)).alias("n_risk"),
        F.coalesce(F.sum("opportunity"), F.lit(0)).alias("n_opportunity"),
        F.countDistinct("source").alias("n_sources"),
    )


def topic_shares(week: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent topics with their share of all rows of the week."""
    total = week.agg(F.count("*").alias("n")).scalar()
    counted = exploded_topics(week).groupBy("topic").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "topic").limit(limit)
    return top.select(
        "topic", text.topic_label("topic").alias("label"), "n", (F.col("n") / total).alias("share")
    )


def topic_headlines(week: DataFrame, per_topic: int = 8, title_length: int = 110) -> DataFrame:
    """Newest headlines per topic, an article counting once per topic.

    The rank filter is applied before the shuffle as well, so a dominant topic sends only
    ``per_topic`` rows per map task.
    """
    hits = exploded_topics(
        week.withColumn("topics", F.array_distinct(F.transform("topics", text.strip_space))),
        "id", "title", "source", "day", "risk", "opportunity",
    )
    newest = Window.partitionBy("topic").orderBy(F.desc("day"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= per_topic)
    return ranked.select(
        "topic", "rank", "id", text.shorten("title", title_length).alias("headline"), "source",
        "day", "risk", "opportunity",
    )


def topic_week_totals(week: DataFrame) -> DataFrame:
    """Articles, risks and opportunities per topic of the week, most frequent first."""
    unique = week.withColumn("topics", F.array_distinct(F.transform("topics", text.strip_space)))
    hits = exploded_topics(unique, "id", "risk", "opportunity")
    return _volume(hits, "topic").orderBy(F.desc("total"), "topic")


def subregion_stats(week: DataFrame, municipalities: DataFrame, **rules) -> DataFrame:
    """Articles, risks and opportunities of every sub-region, zero where there are none."""
    placed = with_subregion(week, municipalities, **rules).filter("subregion is not null")
    counted = placed.groupBy("subregion").agg(
        F.count("*").alias("n"), F.sum("risk").alias("risks"),
        F.sum("opportunity").alias("opportunities"),
    )
    return (
        subregion_order(municipalities)
        .join(counted, "subregion", "left")
        .na.fill(0, ["n", "risks", "opportunities"])
        .orderBy("ord")
    )


def subregion_articles(
    week: DataFrame, municipalities: DataFrame, per_region: int | None = 2, **rules
) -> DataFrame:
    """Articles behind the figures as rows; the newest ``per_region``, or all for None."""
    placed = with_subregion(week, municipalities, **rules).filter("subregion is not null")
    rows = placed.select("subregion", "id", "title", "day", "risk", "opportunity")
    if per_region is None:
        return rows
    newest = Window.partitionBy("subregion").orderBy(F.desc("day"), "id")
    return rows.withColumn("rank", F.row_number().over(newest)).filter(
        F.col("rank") <= per_region
    )


def conclusions(week: DataFrame) -> DataFrame:
    """Totals and the dominant topic of the week in one row."""
    per_topic = exploded_topics(week).groupBy("topic").agg(F.count("*").alias("n"))
    top = per_topic.orderBy(F.desc("n"), "topic").limit(1)
    best = top.select(F.struct("topic", "n").alias("best")).scalar()
    return week.agg(
        F.count("*").alias("n_articles"),
        F.coalesce(F.sum("risk"), F.lit(0)).alias("n_risk"),
        F.coalesce(F.sum("opportunity"), F.lit(0)).alias("n_opportunity"),
    ).select(
        "*",
        F.coalesce(best["topic"], F.lit("N/D")).alias("top_topic"),
        F.coalesce(best["n"], F.lit(0)).alias("top_count"),
    )


def outlook(stats: DataFrame) -> DataFrame:
    """Sentence about the most mentioned sub-region (first in order on ties)."""
    top = stats.orderBy(F.desc("n"), "ord").limit(1)
    sentence = F.format_string(
        "La región %s concentró la mayor actividad noticiosa esta semana con %d menciones.",
        "subregion", "n",
    )
    return top.select("subregion", "n", sentence.alias("sentence"))
