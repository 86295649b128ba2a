"""Daily payload and weekly report tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import frames, listing, rollup, trends
from ..operators.counts import entity_names, region_names, topic_names


def _top_per_day(
    rows: DataFrame, order: list[Column], limit: int, name: str, *fields: Column,
    named: Callable[[DataFrame], DataFrame] = lambda cut: cut,
) -> DataFrame:
    """(day, array of the first ``limit`` structs): ranked and cut on ids, only then named and
    collected, so that names are joined to a few rows a day."""
    w = Window.partitionBy("day").orderBy(*order)
    ranked = named(rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit))
    item = F.struct("_rank", F.struct(*fields).alias("item"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["item"])
    return ranked.groupBy("day").agg(ordered.alias(name))


def daily_payload(
    articles: DataFrame,
    rollups: dict[str, DataFrame],
    topics: DataFrame,
    regions: DataFrame,
    entities: DataFrame,
    days: Iterable[dt.date] | DataFrame | None = None,
) -> DataFrame:
    """(day, payload): the figures of a day as one JSON document, for any number of days.

    Days without a global rollup row have no payload.
    """
    chosen = {name: rollup.on_days(df, days) for name, df in rollups.items()}
    of_days = rollup.on_days(articles, days)
    metrics = ["n_articles", "n_relevant", "n_risk", "n_opportunity", "n_mixed", "n_sources"]
    base = chosen["daily_global"].select("day", F.struct(*metrics).alias("metrics"))
    # the change needs the day before as well, so it reads the unfiltered rollup
    change = trends.day_over_day(rollups["daily_global"]).select(
        "day", F.struct("pct_n_articles", "pct_n_risk", "pct_n_opportunity").alias("change")
    )
    def known(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
        return rows.join(dim.select(F.col("id").alias(key)), key, "left_semi")

    top_topics = _top_per_day(
        known(chosen["daily_topic"], topics, "topic_id"), [F.desc("n_articles"), F.col("topic_id")], 3,
        "top_topics", *[F.col(c) for c in ("topic", "n_articles", "n_risk", "n_opportunity")],
        named=lambda cut: topic_names(cut, topics),
    )
    top_regions = _top_per_day(
        chosen["daily_region"], [F.desc("n_articles"), F.col("region_id"), F.col("geo_level")], 3,
        "top_regions", *[F.col(c) for c in ("region", "geo_level", "n_articles", "n_risk")],
        named=lambda cut: region_names(cut, regions, F.col("geo_level")),
    )
    top_entities = _top_per_day(
        known(chosen["daily_entity"], entities, "entity_id"), [F.desc("mentions"), F.col("entity_id")], 5,
        "top_entities", *[F.col(c) for c in ("entity", "kind", "mentions", "n_risk")],
        named=lambda cut: entity_names(cut, entities),
    )
    highlights = _top_per_day(
        of_days.filter("relevant = 1"), [F.desc("score"), F.col("id")], 3,
        "highlights", *listing.highlight_columns(),
    )
    whole = base
    for part in (change, top_topics, top_regions, top_entities, highlights):
        whole = whole.join(part, "day", "left")
    fields = ["metrics", "change", "top_topics", "top_regions", "top_entities", "highlights"]
    return whole.select("day", F.to_json(F.struct("day", *fields)).alias("payload"), *fields)


def weekly_report(
    rows: DataFrame, municipalities: DataFrame, end: str | dt.date | None = None, **rules
) -> dict[str, DataFrame]:
    """Tables of the weekly report, from exported rows with list columns."""
    week = frames.week_rows(rows, end)
    stats = frames.subregion_stats(week, municipalities, **rules)
    return {
        "kpis": frames.weekly_kpis(week),
        "topic_shares": frames.topic_shares(week),
        "topic_totals": frames.topic_week_totals(week),
        "headlines": frames.topic_headlines(week),
        "subregions": stats,
        "subregion_articles": frames.subregion_articles(week, municipalities, **rules),
        "conclusions": frames.conclusions(week),
        "outlook": frames.outlook(stats),
    }
