"""Feed quality, processing completeness, rollup consistency, health thresholds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.dates import as_date

SAMPLE = 20
TITLE_LENGTH = 80

# fixed values: (metric, warning, critical); 'below' or 'above' is unhealthy
THRESHOLDS = {
    "n_articles": ("below", 50, 10),
    "n_unprocessed": ("above", 10, 100),
    "n_failed_feeds": ("above", 5, 10),
}


def first_entries(entries: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The first entries of each feed in feed order, with their ``rank``.

    The rank filter also runs before the shuffle, so a feed of any length sends at most
    ``limit`` rows per map task.
    """
    w = Window.partitionBy("feed").orderBy("pos")
    return entries.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def sample_titles(entries: DataFrame, count: int = 3, limit: int = SAMPLE) -> DataFrame:
    """(feed, titles): the first ``count`` non-blank titles among the first entries."""
    titled = first_entries(entries, limit).filter(text.strip_space("title") != "")
    return titled.groupBy("feed").agg(_sample(count).alias("sample_titles"))


def _sample(count: int) -> Column:
    # at most SAMPLE rows per feed get here
    title = F.when(_filled("title"), F.struct("rank", F.substring("title", 1, TITLE_LENGTH).alias("t")))
    ordered = F.transform(F.array_sort(F.collect_list(title)), lambda s: s["t"])
    return F.slice(ordered, 1, count)


def _filled(c: str) -> Column:
    return F.coalesce(text.strip_space(c), F.lit("")) != ""


def feed_profile(
    entries: DataFrame, feeds: DataFrame, as_of: Column | dt.datetime, days: int = 7
) -> DataFrame:
    """Completeness and freshness per feed.

    ``entries``: (feed, pos, title, description, published TIMESTAMP, dated INT); ``feeds``:
    (feed). A feed without entries has status 'empty'.
    """
    totals = entries.groupBy("feed").agg(F.count("*").alias("n_entries"))
    recent = F.col("published") > F.lit(as_of) - F.make_dt_interval(F.lit(days))
    sampled = (
        first_entries(entries)
        .groupBy("feed")
        .agg(
            F.count("*").alias("_size"),
            F.count_if(_filled("title")).alias("_titles"),
            F.count_if(F.col("dated") == 1).alias("_dates"),
            F.count_if(_filled("description")).alias("_descriptions"),
            F.count_if(recent).alias("n_recent"),
            _sample(3).alias("sample_titles"),
        )
    )
    profile = feeds.join(totals, "feed", "left").join(sampled, "feed", "left")
    n = F.coalesce("n_entries", F.lit(0))
    has = {
        "has_titles": F.col("_titles") >= F.col("_size") * 0.8,
        "has_dates": F.col("_dates") >= F.col("_size") * 0.5,
        "has_descriptions": F.col("_descriptions") >= F.col("_size") * 0.5,
    }
    flagged = profile.select(
        "feed",
        n.alias("n_entries"),
        F.when(n > 0, "ok").otherwise("empty").alias("status"),
        *[F.coalesce(test.cast("int"), F.lit(0)).alias(name) for name, test in has.items()],
        F.coalesce("n_recent", F.lit(0)).alias("n_recent"),
        F.coalesce("sample_titles", F.array().cast("array<string>")).alias("sample_titles"),
    )
    ok = F.col("status") == "ok"
    warnings = F.array_compact(
        F.array(
            F.when(~ok, F.lit("No entries found")),
            F.when(ok & (F.col("has_titles") == 0), F.lit("Missing titles in >20% entries")),
            F.when(ok & (F.col("has_dates") == 0), F.lit("Missing dates in >50% entries")),
            F.when(ok & (F.col("n_recent") == 0), F.lit("No entries from last 7 days")),
        )
    )
    return flagged.withColumn("warnings", warnings)


def feed_scores(profile: DataFrame) -> DataFrame:
    """Score 0-4 and verdict per feed."""
    recent = (F.col("n_recent") > 0).cast("int")
    score = F.col("has_titles") + F.col("has_dates") + F.col("has_descriptions") + recent
    ok = F.col("status") == "ok"
    verdict = (
        F.when(ok & (F.size("warnings") == 0), "ok").when(ok, "warning").otherwise("failed")
    )
    return profile.select("feed", F.when(ok, score).alias("score"), verdict.alias("verdict"))


def feed_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("ok", "warning", "failed")]
    )


def completeness(status: DataFrame, day: str | dt.date | None = None) -> DataFrame:
    """Done and pending counts per stage, optionally of one day."""
    rows = status if day is None else status.filter(F.col("day") == as_date(day))
    stages = ("topics", "entities", "signals")
    return rows.agg(
        F.count("*").alias("n_articles"),
        *[F.count_if(F.col(f"{s}_done") == 1).alias(f"{s}_done") for s in stages],
        *[F.count_if(F.coalesce(f"{s}_done", F.lit(0)) == 0).alias(f"{s}_pending") for s in stages],
    )


def rollup_gaps(articles: DataFrame, daily_global: DataFrame) -> DataFrame:
    """Days on which the rollup disagrees with the rows it was made from."""
    raw = articles.filter("day is not null").groupBy("day").agg(F.count("*").alias("raw_count"))
    rollup = daily_global.select("day", F.col("n_articles").alias("rollup_count"))
    both = raw.join(rollup, "day", "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_count", "rollup_count")]
    compared = both.select("day", *counts)
    return compared.withColumn("difference", F.col("raw_count") - F.col("rollup_count"))


def entity_kinds(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def health_level(metric: str, value: str | Column) -> Column:
    direction, warning, critical = THRESHOLDS[metric]
    v = F.col(value) if isinstance(value, str) else value
    if direction == "below":
        return F.when(v < critical, "critical").when(v < warning, "warning").otherwise("ok")
    return F.when(v > critical, "critical").when(v > warning, "warning").otherwise("ok")


def daily_health(articles: DataFrame) -> DataFrame:
    """Per day: article count and rows with a stage pending, with their health levels."""
    pending = F.coalesce("topics_done", F.lit(0)) * F.coalesce("entities_done", F.lit(0)) == 0
    per_day = articles.groupBy("day").agg(
        F.count("*").alias("n_articles"), F.count_if(pending).alias("n_unprocessed")
    )
    return per_day.select(
        "*",
        health_level("n_articles", "n_articles").alias("volume_health"),
        health_level("n_unprocessed", "n_unprocessed").alias("backlog_health"),
    )


def constraint_violations(regions: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose kind is outside the allowed set."""
    bad_regions = regions.filter(~F.col("kind").isin(*schemas.REGION_KINDS))
    bad_entities = entities.filter(~F.col("kind").isin(*schemas.ENTITY_KINDS))
    return bad_regions.select(F.lit("region").alias("table"), "id", "kind").union(
        bad_entities.select(F.lit("entity").alias("table"), "id", "kind")
    )


def duplicate_ids(table: DataFrame, key: str = "id") -> DataFrame:
    """Ids used more than once (a hash id colliding would show here)."""
    return table.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
