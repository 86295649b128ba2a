"""Daily rollups. Each is one aggregation over any set of days; no loop over days.

Partial aggregation runs before every shuffle, so a day, source or entity holding a large
share of the rows sends one row per map task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..session import written


def count_where(flag: str) -> Column:
    return F.count_if(F.col(flag) == 1)


def days_with_data(articles: DataFrame) -> DataFrame:
    return articles.select("day").filter(F.col("day").isNotNull()).distinct().orderBy("day")


def on_days(articles: DataFrame, days: Iterable[dt.date] | DataFrame | None) -> DataFrame:
    """Rows of the given days (values or a ``day`` frame); all dated rows for None."""
    if days is None:
        return articles.filter(F.col("day").isNotNull())
    if isinstance(days, DataFrame):
        return articles.join(days.select("day").distinct(), "day", "left_semi")
    return articles.filter(F.col("day").isin(list(days)))


def daily_global(articles: DataFrame) -> DataFrame:
    return articles.groupBy("day").agg(
        F.count("*").alias("n_articles"),
        count_where("relevant").alias("n_relevant"),
        count_where("risk").alias("n_risk"),
        count_where("opportunity").alias("n_opportunity"),
        F.count_if((F.col("risk") == 1) & (F.col("opportunity") == 1)).alias("n_mixed"),
        F.countDistinct("source").alias("n_sources"),
        count_where("deep_analysis").alias("n_deep"),
    )


def _linked(articles: DataFrame, links: DataFrame) -> DataFrame:
    flags = articles.select(F.col("id").alias("article_id"), "day", "risk", "opportunity")
    return flags.join(links, "article_id")


def daily_topic(articles: DataFrame, article_topic: DataFrame) -> DataFrame:
    return (
        _linked(articles, article_topic)
        .groupBy("day", "topic_id")
        .agg(
            F.count("*").alias("n_articles"),
            count_where("risk").alias("n_risk"),
            count_where("opportunity").alias("n_opportunity"),
            F.avg("score").alias("avg_score"),
        )
    )


def daily_region(articles: DataFrame) -> DataFrame:
    """Relevant articles only; region -1 stands for none."""
    return (
        articles.filter("relevant = 1")
        .groupBy(
            "day",
            F.coalesce("region_id", F.lit(-1)).cast("long").alias("region_id"),
            F.coalesce("geo_level", F.lit(lexicon.UNKNOWN_LEVEL)).alias("geo_level"),
        )
        .agg(
            F.count("*").alias("n_articles"),
            count_where("risk").alias("n_risk"),
            count_where("opportunity").alias("n_opportunity"),
        )
    )


def daily_entity(articles: DataFrame, article_entity: DataFrame) -> DataFrame:
    return (
        _linked(articles, article_entity)
        .groupBy("day", "entity_id")
        .agg(
            F.count("*").alias("mentions"),
            count_where("risk").alias("n_risk"),
            count_where("opportunity").alias("n_opportunity"),
            F.sum("freq").alias("freq_total"),
        )
    )


def daily_source(articles: DataFrame) -> DataFrame:
    """Rows without a source are left out; the quality job reports them."""
    return (
        articles.filter(F.col("source").isNotNull())
        .groupBy("day", "source")
        .agg(
            F.count("*").alias("n_articles"),
            count_where("relevant").alias("n_relevant"),
            count_where("risk").alias("n_risk"),
            count_where("opportunity").alias("n_opportunity"),
        )
    )


ROLLUPS = ("daily_global", "daily_topic", "daily_region", "daily_entity", "daily_source")
_COUNTS = ("n_articles", "n_relevant", "n_risk", "n_opportunity", "n_mixed", "n_deep")


def fine_counts(articles: DataFrame) -> DataFrame:
    """Counts by day, source and, for relevant articles, region and level: what the global, region
    and source rollups are sums of. One pass over the articles, combined before the shuffle."""
    relevant = F.coalesce(F.col("relevant") == 1, F.lit(False))
    region = F.coalesce("region_id", F.lit(-1)).cast("long")
    level = F.coalesce("geo_level", F.lit(lexicon.UNKNOWN_LEVEL))
    return articles.groupBy(
        "day", "source", relevant.alias("is_relevant"),
        F.when(relevant, region).alias("region_id"), F.when(relevant, level).alias("geo_level"),
    ).agg(
        F.count("*").alias("n_articles"),
        count_where("relevant").alias("n_relevant"),
        count_where("risk").alias("n_risk"),
        count_where("opportunity").alias("n_opportunity"),
        F.count_if((F.col("risk") == 1) & (F.col("opportunity") == 1)).alias("n_mixed"),
        count_where("deep_analysis").alias("n_deep"),
    )


def _sums(fine: DataFrame, keys: list[str], *names: str) -> DataFrame:
    return fine.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def from_fine(fine: DataFrame) -> dict[str, DataFrame]:
    """The global, region and source rollups of fine counts."""
    by_source = _sums(fine, ["day", "source"], *_COUNTS)
    whole = by_source.groupBy("day").agg(
        *[F.sum(n).alias(n) for n in _COUNTS[:5]], F.count("source").alias("n_sources"), F.sum("n_deep").alias("n_deep")
    )
    return {
        "daily_global": whole,
        "daily_region": _sums(
            fine.filter("is_relevant"), ["day", "region_id", "geo_level"], "n_articles", "n_risk", "n_opportunity"
        ),
        "daily_source": by_source.filter(F.col("source").isNotNull()).select("day", "source", *_COUNTS[:4]),
    }


def rollup_all(
    articles: DataFrame,
    article_topic: DataFrame,
    article_entity: DataFrame,
    days: Iterable[dt.date] | DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All five rollups for the given days, or for every day (backfill).

    Three come from one written table of fine counts. Bridges that carry the day of their articles
    are cut to the days before they are joined.
    """
    chosen = on_days(articles, days)
    from_counts = from_fine(written(fine_counts(chosen), "fine_counts"))
    topic, entity = (
        on_days(links, days).drop("day") if "day" in links.columns else links for links in (article_topic, article_entity)
    )
    made = {**from_counts, "daily_topic": daily_topic(chosen, topic), "daily_entity": daily_entity(chosen, entity)}
    return {name: made[name] for name in ROLLUPS}
