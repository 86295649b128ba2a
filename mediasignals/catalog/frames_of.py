"""Frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, ingest, rollup
from .views import NEWS_OPPORTUNITY, NEWS_RISK, NEWS_TOPICS, Tables


def news_classified(t: Tables) -> DataFrame:
    """Deduplicated, classified documents."""
    unique = ingest.first_per_key(t("news"), ["url"], ["id"])
    return classify.classify(unique, NEWS_TOPICS, NEWS_RISK, NEWS_OPPORTUNITY)


def rollup_of(t: Tables, name: str) -> DataFrame:
    """One rollup of the star view."""
    if name == "daily_topic":
        return rollup.daily_topic(t("articles"), t("article_topic"))
    if name == "daily_entity":
        return rollup.daily_entity(t("articles"), t("article_entity"))
    return getattr(rollup, name)(t("articles"))


def series_global(t: Tables) -> DataFrame:
    return rollup.daily_global(t("series"))


def export_frame(t: Tables) -> DataFrame:
    """Export rows with list columns and kind."""
    rows = t("export_rows").withColumns(
        {
            "topics": text.split_list("topics_text", "|"),
            "persons": text.split_list("persons_text"),
            "orgs": text.split_list("orgs_text"),
            "places": text.split_list("places_text"),
            "kind": text.signal_kind(),
        }
    )
    return rows.drop("topics_text", "persons_text", "orgs_text", "places_text")


def local_frame(t: Tables) -> DataFrame:
    return t("local_news").withColumn("places", text.split_list("places_text"))


def text_list(c: str, separator: str = ",") -> Column:
    return F.array_join(c, separator).alias(c)

