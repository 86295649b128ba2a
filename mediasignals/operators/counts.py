"""Counts over articles, bridges and rollups.

Facts are aggregated by id before a dimension adds its names, so no name join sees more
rows than there are ids. Dimension sizes are left to Spark's own size check (static and
adaptive broadcast threshold): none is hinted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.dates import as_date, date_range, last_days
from .rollup import count_where

Day = str | dt.date | None


def _dim(dim: DataFrame, key: str, **columns: str) -> DataFrame:
    """id and renamed columns of a dimension."""
    return dim.select(F.col("id").alias(key), *[F.col(v).alias(k) for k, v in columns.items()])


def _flags(articles: DataFrame) -> DataFrame:
    return articles.withColumnRenamed("id", "article_id")


# --- straight from articles and bridges -----------------------------------------------


def articles_by_topic(
    articles: DataFrame, article_topic: DataFrame, topics: DataFrame, name: str,
    start: Day = None, end: Day = None,
) -> DataFrame:
    wanted = _dim(topics.filter(F.col("name") == name), "topic_id")
    ids = article_topic.join(wanted, "topic_id", "left_semi").select("article_id")
    rows = date_range(articles, start, end).select(
        "id", "title", "day", "source", "risk", "opportunity"
    )
    found = rows.join(ids.withColumnRenamed("article_id", "id"), "id")
    return found.orderBy(F.desc("day"), "id")


def count_by_topic(
    articles: DataFrame, article_topic: DataFrame, topics: DataFrame,
    start: Day = None, end: Day = None,
) -> DataFrame:
    linked = _flags(date_range(articles, start, end)).join(article_topic, "article_id")
    per_id = linked.groupBy("topic_id").agg(
        F.count("*").alias("n"), F.sum("risk").alias("r"), F.sum("opportunity").alias("o")
    )
    named = per_id.join(_dim(topics, "topic_id", topic="name"), "topic_id")
    return (
        named.groupBy("topic")
        .agg(
            F.sum("n").alias("total"), F.sum("r").alias("risks"),
            F.sum("o").alias("opportunities"),
        )
        .orderBy(F.desc("total"), "topic")
    )


def entity_articles(
    articles: DataFrame, article_entity: DataFrame, entities: DataFrame
) -> DataFrame:
    """entity x article rows: (entity_id, name, kind, article_id, day, role)."""
    dated = articles.select(F.col("id").alias("article_id"), "day")
    return (
        article_entity.join(dated, "article_id")
        .join(_dim(entities, "entity_id", name="name", kind="kind"), "entity_id")
        .select("entity_id", "name", "kind", "article_id", "day", "role")
    )


def top_entities(
    articles: DataFrame, article_entity: DataFrame, entities: DataFrame,
    kind: str | None = None, limit: int = 20, start: Day = None, end: Day = None,
) -> DataFrame:
    """Most mentioned entities with mentions and distinct articles.

    Links of other kinds go first. The rest is sorted by article, where a link's first row counts
    its article: a sort takes less memory for a link than a hash table of links.
    """
    dim = _dim(entities if kind is None else entities.filter(F.col("kind") == kind),
               "entity_id", entity="name", kind="kind")
    links = article_entity.select("article_id", "entity_id")
    if kind is not None:
        links = links.join(dim.select("entity_id"), "entity_id", "left_semi")
    if start is not None or end is not None:
        ids = date_range(articles, start, end).select(F.col("id").alias("article_id"))
    else:
        ids = articles.select(F.col("id").alias("article_id"))
    links = links.join(ids, "article_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("article_id", "entity_id").orderBy("entity_id"))
    per_id = links.withColumn("nth", nth).groupBy("entity_id").agg(
        F.count("*").alias("mentions"), F.count_if(F.col("nth") == 1).alias("articles")
    )
    named = per_id.join(dim, "entity_id")
    return named.orderBy(F.desc("mentions"), "entity_id").limit(limit)


def entity_timeline(
    articles: DataFrame, article_entity: DataFrame, entities: DataFrame,
    name: str | Column, as_of: str | dt.date, days: int = 30,
) -> DataFrame:
    wanted = _dim(entities.filter(F.col("name") == name), "entity_id")
    ids = article_entity.join(wanted, "entity_id", "left_semi").select("article_id")
    recent = last_days(articles, as_of, days).select(F.col("id").alias("article_id"), "day")
    return recent.join(ids, "article_id").groupBy("day").agg(
        F.count("*").alias("mentions")
    ).orderBy("day")


def key_entities_at_risk(
    articles: DataFrame, article_entity: DataFrame, entities: DataFrame,
    start: Day = None, end: Day = None,
) -> DataFrame:
    keys = _dim(entities.filter("is_key = 1"), "entity_id", entity="name", category="category")
    risky = date_range(articles.filter("risk = 1"), start, end)
    links = article_entity.select("article_id", "entity_id").join(
        risky.select(F.col("id").alias("article_id")), "article_id", "left_semi"
    )
    per_id = links.groupBy("entity_id").agg(F.count("*").alias("risk_mentions"))
    return per_id.join(keys, "entity_id").orderBy(F.desc("risk_mentions"), "entity_id")


def articles_with_region(articles: DataFrame, regions: DataFrame) -> DataFrame:
    """Inner join to the region dimension; articles without a region fall out."""
    placed = articles.filter("region_id is not null")
    return placed.join(_dim(regions, "region_id", region="name", region_kind="kind"), "region_id")


def count_by_region(
    articles: DataFrame, regions: DataFrame, start: Day = None, end: Day = None
) -> DataFrame:
    placed = date_range(articles, start, end).filter("region_id is not null")
    per_id = placed.groupBy("region_id").agg(
        F.count("*").alias("total"), F.sum("risk").alias("risks"),
        F.sum("opportunity").alias("opportunities"),
    )
    dim = _dim(regions, "region_id", region="name", region_kind="kind")
    return per_id.join(dim, "region_id").orderBy(F.desc("total"), "region_id")


def topic_region_counts(
    articles: DataFrame, article_topic: DataFrame, topics: DataFrame, regions: DataFrame,
    start: Day = None, end: Day = None,
) -> DataFrame:
    """Topic x region cross-tab, long form."""
    placed = date_range(articles, start, end).filter("region_id is not null")
    linked = placed.select(F.col("id").alias("article_id"), "region_id").join(
        article_topic, "article_id"
    )
    per_ids = linked.groupBy("topic_id", "region_id").agg(F.count("*").alias("total"))
    return (
        per_ids.join(_dim(topics, "topic_id", topic="name"), "topic_id")
        .join(_dim(regions, "region_id", region="name"), "region_id")
        .select("topic_id", "topic", "region_id", "region", "total")
        .orderBy(F.desc("total"), "topic_id", "region_id")
    )


def count_by_day(articles: DataFrame, as_of: str | dt.date, days: int = 30) -> DataFrame:
    return (
        last_days(articles, as_of, days)
        .groupBy("day")
        .agg(
            F.count("*").alias("total"), count_where("relevant").alias("relevant"),
            F.sum("risk").alias("risks"), F.sum("opportunity").alias("opportunities"),
        )
        .orderBy("day")
    )


def count_by_source(articles: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    return (
        date_range(articles, start, end)
        .groupBy("source")
        .agg(
            F.count("*").alias("total"), count_where("relevant").alias("relevant"),
            F.sum("risk").alias("risks"), F.sum("opportunity").alias("opportunities"),
        )
        .orderBy(F.desc("total"), "source")
    )


def period_summary(articles: DataFrame, start: Day, end: Day) -> DataFrame:
    return date_range(articles, start, end).agg(
        F.count("*").alias("n_articles"),
        count_where("relevant").alias("n_relevant"),
        F.sum("risk").alias("n_risk"),
        F.sum("opportunity").alias("n_opportunity"),
        F.count_if((F.col("risk") == 1) & (F.col("opportunity") == 1)).alias("n_mixed"),
        F.countDistinct("source").alias("n_sources"),
        F.sum("deep_analysis").alias("n_deep"),
    )


def exported_articles(
    articles: DataFrame, article_topic: DataFrame, topics: DataFrame, ordered: bool = True
) -> DataFrame:
    """Relevant articles with their topics joined by '|' (null without any), newest first unless
    the writer orders them.

    Names are concatenated on the bridge first, so long article rows are shuffled once and
    never multiplied.
    """
    names = article_topic.join(_dim(topics, "topic_id", name="name"), "topic_id")
    joined = names.groupBy(F.col("article_id").alias("id")).agg(topic_text().alias("topics"))
    columns = [
        "id", "day", "source", "title", "url", "persons", "orgs", "places", "geo_level",
        "deep_analysis", "risk", "opportunity",
    ]
    rows = articles.filter("relevant = 1").select(*columns)
    whole = rows.join(joined, "id", "left")
    return whole.orderBy(F.desc("day"), "id") if ordered else whole


def topic_text() -> Column:
    """Topic names of one article as '|' text, in alphabetical order."""
    return F.array_join(F.array_sort(F.collect_list("name")), "|")


def system_health(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("n_articles"), F.max("day").alias("last_day"))


def level_distribution(
    articles: DataFrame, start: Day, end: Day, level: str = "all"
) -> DataFrame:
    rows = date_range(articles, start, end)
    if level and level != "all":
        rows = rows.filter(F.col("geo_level") == level)
    return (
        rows.groupBy("geo_level")
        .agg(
            F.count("*").alias("n_articles"), F.sum("risk").alias("n_risk"),
            F.sum("opportunity").alias("n_opportunity"),
        )
        .orderBy(F.desc("n_articles"), "geo_level")
    )


# --- from rollups ---------------------------------------------------------------------


def global_metrics(daily_global: DataFrame, day: str | dt.date) -> DataFrame:
    """Metrics of one day, empty if the day has no rollup."""
    metrics = ["n_articles", "n_relevant", "n_risk", "n_opportunity", "n_mixed", "n_sources"]
    return daily_global.filter(F.col("day") == as_date(day)).select(
        "day", *[F.coalesce(m, F.lit(0)).alias(m) for m in metrics]
    )


def daily_series(
    daily_global: DataFrame, start: Day = None, end: Day = None,
    as_of: Day = None, days: int | None = None,
) -> DataFrame:
    """Global rollup rows of a closed range or of the last ``days`` days."""
    rows = date_range(daily_global, start, end) if days is None else last_days(daily_global, as_of, days)
    return rows.orderBy("day")


def source_series(daily_source: DataFrame, as_of: str | dt.date, days: int = 30) -> DataFrame:
    return last_days(daily_source, as_of, days).orderBy("day", "source")


def topic_names(daily_topic: DataFrame, topics: DataFrame) -> DataFrame:
    return daily_topic.join(_dim(topics, "topic_id", topic="name"), "topic_id")


def entity_names(daily_entity: DataFrame, entities: DataFrame) -> DataFrame:
    return daily_entity.join(_dim(entities, "entity_id", entity="name", kind="kind"), "entity_id")


def region_names(daily_region: DataFrame, regions: DataFrame, label: str | Column) -> DataFrame:
    """Left join that never matches the -1 sentinel; ``label`` names rows without a region."""
    fallback = F.lit(label) if isinstance(label, str) else label
    dim = regions.select(F.col("id").alias("_rid"), F.col("name").alias("_rname"))
    matched = daily_region.join(
        dim, (F.col("region_id") == F.col("_rid")) & (F.col("region_id") != -1), "left"
    )
    region = F.when(F.col("region_id") == -1, fallback).otherwise(F.coalesce("_rname", fallback))
    return matched.withColumn("region", region).drop("_rid", "_rname")


def topic_series(
    daily_topic: DataFrame, topics: DataFrame, topic_id: int, as_of: str | dt.date, days: int = 30
) -> DataFrame:
    rows = last_days(daily_topic.filter(F.col("topic_id") == topic_id), as_of, days)
    return topic_names(rows, topics).select(
        "day", "topic", "n_articles", "n_risk", "n_opportunity", "avg_score"
    ).orderBy("day")


def entity_series(
    daily_entity: DataFrame, entities: DataFrame, entity_id: int, as_of: str | dt.date, days: int = 30
) -> DataFrame:
    rows = last_days(daily_entity.filter(F.col("entity_id") == entity_id), as_of, days)
    return entity_names(rows, entities).select(
        "day", "entity", "kind", "mentions", "n_risk", "n_opportunity", "freq_total"
    ).orderBy("day")


def top_entities_of_period(
    daily_entity: DataFrame, entities: DataFrame, as_of: str | dt.date, days: int = 30,
    limit: int = 20, kind: str | None = None,
) -> DataFrame:
    """Top entities from the rollup with their number of active days."""
    per_id = last_days(daily_entity, as_of, days).groupBy("entity_id").agg(
        F.sum("mentions").alias("mentions"), F.sum("n_risk").alias("n_risk"),
        F.sum("n_opportunity").alias("n_opportunity"),
        F.countDistinct("day").alias("active_days"),
    )
    dim = entities if kind is None else entities.filter(F.col("kind") == kind)
    named = per_id.join(
        _dim(dim, "entity_id", entity="name", kind="kind", is_key="is_key", category="category"),
        "entity_id",
    )
    return named.orderBy(F.desc("mentions"), "entity_id").limit(limit)


def top_mentioned(
    daily_entity: DataFrame, entities: DataFrame, as_of: str | dt.date, days: int = 30,
    limit: int = 20,
) -> DataFrame:
    per_id = last_days(daily_entity, as_of, days).groupBy("entity_id").agg(
        F.sum("mentions").alias("mentions")
    )
    named = per_id.join(_dim(entities, "entity_id", entity="name", kind="kind"), "entity_id")
    return (
        named.withColumn("kind", F.coalesce("kind", F.lit("")))
        .orderBy(F.desc("mentions"), "entity_id")
        .limit(limit)
    )


def entity_trends(
    daily_entity: DataFrame, entities: DataFrame, start: Day, end: Day, limit: int = 20
) -> DataFrame:
    per_id = date_range(daily_entity, start, end).groupBy("entity_id").agg(
        F.sum("mentions").alias("mentions"), F.sum("n_risk").alias("n_risk"),
        F.sum("n_opportunity").alias("n_opportunity"),
    )
    named = per_id.join(_dim(entities, "entity_id", entity="name", kind="kind"), "entity_id")
    return named.orderBy(F.desc("mentions"), "entity_id").limit(limit)


def entity_sparkline(
    daily_entity: DataFrame, entities: DataFrame, name: str | Column, start: Day, end: Day
) -> DataFrame:
    wanted = _dim(entities.filter(F.col("name") == name), "entity_id")
    return (
        date_range(daily_entity, start, end)
        .join(wanted, "entity_id", "left_semi")
        .groupBy("day")
        .agg(F.sum("mentions").alias("mentions"))
        .orderBy("day")
    )


def top_entity_series(
    daily_entity: DataFrame, entities: DataFrame, as_of: str | dt.date,
    top_n: int = 10, days: int = 30,
) -> DataFrame:
    """Daily rows of the ``top_n`` entities of the window: semi-join, one plan."""
    recent = last_days(daily_entity, as_of, days)
    top = (
        recent.groupBy("entity_id")
        .agg(F.sum("mentions").alias("_n"))
        .orderBy(F.desc("_n"), "entity_id")
        .limit(top_n)
        .select("entity_id")
    )
    rows = recent.join(top, "entity_id", "left_semi")
    return entity_names(rows, entities).orderBy("day", "entity")


def topic_trends(
    daily_topic: DataFrame, topics: DataFrame, start: Day = None, end: Day = None,
    as_of: Day = None, days: int | None = None,
) -> DataFrame:
    rows = date_range(daily_topic, start, end) if days is None else last_days(daily_topic, as_of, days)
    return topic_names(rows, topics).orderBy("day", "topic")


def region_trends(
    daily_region: DataFrame, regions: DataFrame, as_of: str | dt.date, days: int = 30
) -> DataFrame:
    named = region_names(last_days(daily_region, as_of, days), regions, lexicon.NO_REGION)
    return named.orderBy("day", "geo_level", "region_id")


def source_volume(
    daily_source: DataFrame, start: Day, end: Day, limit: int | None = None
) -> DataFrame:
    totals = (
        date_range(daily_source, start, end)
        .groupBy("source")
        .agg(*[F.sum(m).alias(m) for m in ("n_articles", "n_relevant", "n_risk", "n_opportunity")])
        .orderBy(F.desc("n_articles"), "source")
    )
    return totals if limit is None else totals.limit(limit)


def topic_totals(daily_topic: DataFrame, topics: DataFrame, start: Day, end: Day) -> DataFrame:
    per_id = date_range(daily_topic, start, end).groupBy("topic_id").agg(
        *[F.sum(m).alias(m) for m in ("n_articles", "n_risk", "n_opportunity")]
    )
    return (
        topic_names(per_id, topics)
        .groupBy("topic")
        .agg(*[F.sum(m).alias(m) for m in ("n_articles", "n_risk", "n_opportunity")])
        .orderBy("n_articles", "topic")
    )


def top_of_day(rows: DataFrame, measure: str, tie: list[str], limit: int) -> DataFrame:
    return rows.orderBy(F.desc(measure), *tie).limit(limit)


def top_topics_of_day(daily_topic: DataFrame, topics: DataFrame, day, limit: int = 3) -> DataFrame:
    rows = topic_names(daily_topic.filter(F.col("day") == as_date(day)), topics)
    return top_of_day(rows, "n_articles", ["topic_id"], limit).select(
        "topic", "n_articles", "n_risk", "n_opportunity"
    )


def top_regions_of_day(daily_region: DataFrame, regions: DataFrame, day, limit: int = 3) -> DataFrame:
    rows = region_names(
        daily_region.filter(F.col("day") == as_date(day)), regions, F.col("geo_level")
    )
    return top_of_day(rows, "n_articles", ["region_id", "geo_level"], limit).select(
        "region", "geo_level", "n_articles", "n_risk"
    )


def top_entities_of_day(daily_entity: DataFrame, entities: DataFrame, day, limit: int = 5) -> DataFrame:
    rows = entity_names(daily_entity.filter(F.col("day") == as_date(day)), entities)
    return top_of_day(rows, "mentions", ["entity_id"], limit).select(
        "entity", "kind", "mentions", "n_risk"
    )
