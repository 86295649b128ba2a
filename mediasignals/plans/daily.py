"""The daily run and the backfill."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon, schemas
from ..functions.dates import date_range
from ..operators import classify, entities, geo, ingest, rollup
from ..operators.counts import exported_articles
from ..session import written
from ..sources import reports, tables
from ..sources.publish import Version
from .report import daily_payload

log = logging.getLogger(__name__)


@dataclass
class Rules:
    """Dictionaries of a run."""

    topics: classify.Topics
    risk: list[str]
    opportunity: list[str]


DEFAULT_RULES = Rules(lexicon.TOPICS, lexicon.RISK_TERMS, lexicon.OPPORTUNITY_TERMS)


class Outcome(dict[str, list[str]]):
    """Table and export names -> the folders that make them up in the version of the run; ``failed``
    has the exports that failed, and why."""

    def __init__(self, version: Version):
        super().__init__({name: version.paths(name) for name in version.parts})
        self.number = version.number
        self.failed: dict[str, str] = {}


_DAY = T.StructField("day", T.DateType())
LINKED_TOPIC = T.StructType([*schemas.ARTICLE_TOPIC.fields, _DAY])
LINKED_ENTITY = T.StructType([*schemas.ARTICLE_ENTITY.fields, _DAY])
ROLLUP_SCHEMAS = {
    "daily_global": schemas.DAILY_GLOBAL,
    "daily_topic": schemas.DAILY_TOPIC,
    "daily_region": schemas.DAILY_REGION,
    "daily_entity": schemas.DAILY_ENTITY,
    "daily_source": schemas.DAILY_SOURCE,
}


def classified_articles(
    rows: DataFrame, gazetteer: DataFrame, regions: DataFrame, rules: Rules = DEFAULT_RULES
) -> DataFrame:
    """New article rows -> topics, signals, names, geography; relevant rows get names.

    The scored rows are needed twice, so they are written once: otherwise deduplication and
    matching would run for each use.
    """
    scored = written(classify.classify(rows, rules.topics, rules.risk, rules.opportunity), "scored")
    found = entities.mention_arrays(
        entities.extract_by_gazetteer(scored.filter("relevant = 1"), gazetteer)
    ).withColumnRenamed("article_id", "id")
    named = scored.join(found, "id", "left")
    no_names = F.array().cast("array<string>")
    relevant = F.col("relevant") == 1
    named = named.withColumns(
        {c: F.when(relevant, F.coalesce(c, no_names)) for c in ("persons", "orgs", "places")}
    )
    located = geo.with_geo_level(geo.with_region(named, regions))
    return located.withColumns(
        {
            "geo_level": F.when(relevant, F.col("geo_level")),
            "deep_analysis": F.when(relevant, geo.deep_analysis("places", "orgs")).otherwise(0),
        }
    )


def run_daily(
    spark: SparkSession,
    entries: DataFrame,
    root: str,
    as_of: str | dt.date,
    gazetteer: DataFrame,
    topics: DataFrame,
    regions: DataFrame,
    rules: Rules = DEFAULT_RULES,
    run: str | None = None,
) -> Outcome:
    """Ingest landed entries, classify, link, roll up the days touched, export.

    The run writes to folders of its own and publishes all of them in one step: readers of the
    newest version see every table, rollup and export of the run, or none. A run repeated under
    the same ``run`` name (default: ``as_of``) replaces what it put; days that only its former rows
    touched are rolled up and exported anew too. Exports are kept by day, those of the warehouse
    by run, so that a run writes what it touched. An export may fail without losing the run: its
    former state stays, and the outcome says so.
    """
    version = Version.open(spark, root, run or str(as_of))
    dated = ingest.article_rows(entries, as_of)
    stored = version.read("articles", schemas.ARTICLES, earlier_only=True)
    fresh = ingest.with_ids(ingest.new_articles(dated, stored)).withColumn(
        "ingested_at", F.lit(str(as_of)).cast("timestamp")
    )
    former = version.days("articles")
    version.put(
        "articles",
        classified_articles(fresh, gazetteer, regions, rules).select(*schemas.ARTICLES.fieldNames()),
        by_day=True,
    )
    folder = version.parts["articles"][version.run]
    batch = spark.read.schema(schemas.ARTICLES).parquet(f"{version.root}/{folder}")

    known = version.read("entities", schemas.ENTITIES, earlier_only=True)
    aliases = version.read("entity_alias", schemas.ENTITY_ALIAS, earlier_only=True)
    mentions = entities.mentions_of(batch)
    resolved = written(entities.resolve_keys(mentions, aliases, known, newest_first(batch)), "resolved")
    days_of = batch.select(F.col("id").alias("article_id"), "day")
    version.put("article_topic", classify.topic_links(batch, topics).join(days_of, "article_id"), by_day=True)
    version.put("article_entity", entities.entity_links(mentions, resolved).join(days_of, "article_id"), by_day=True)
    version.put("entity_alias", entities.new_aliases(resolved))
    version.put("entities", entities.new_entities(resolved))

    touched = sorted({*former, *version.days("articles")})
    rollups = refresh_rollups(version, touched)
    failed = export_days(version, touched, rollups, topics, regions)
    version.publish()
    outcome = Outcome(version)
    outcome.failed = failed
    return outcome


def newest_first(articles: DataFrame) -> DataFrame:
    """(article_id, turn): the order in which entity work takes articles, newest days first."""
    turn = -F.unix_date("day").cast("long")
    return articles.select(F.col("id").alias("article_id"), turn.alias("turn"))


def export_days(
    version: Version, days: list[dt.date], rollups: dict[str, DataFrame], topics: DataFrame, regions: DataFrame
) -> dict[str, str]:
    """The exports of the touched days, and the warehouse rows of the run; returns what failed."""
    articles = rollup.on_days(version.read("articles", schemas.ARTICLES), days)
    links = rollup.on_days(version.read("article_topic", LINKED_TOPIC), days)
    names = version.read("entities", schemas.ENTITIES)
    payload = daily_payload(articles, rollups, topics, regions, names, days)
    steps = {
        "signals_csv": lambda at: reports.write_signal_csv(articles, at),
        "payload": lambda at: reports.write_payload(payload, at),
        "dashboard_csv": lambda at: reports.write_dashboard_csv(
            exported_articles(articles, links.drop("day"), topics, ordered=False), at
        ),
    }
    failed = {}
    for name, step in steps.items():
        try:
            version.put_days(name, step, days)
        except Exception as problem:
            log.exception("export %s failed; the run goes on", name)
            failed[name] = str(problem)
    whole = {"topics": topics, "regions": regions}
    own = {
        "articles": schemas.ARTICLES, "entities": schemas.ENTITIES,
        "article_topic": LINKED_TOPIC, "article_entity": LINKED_ENTITY,
    }
    try:
        for name, columns in tables.WAREHOUSE_TABLES.items():
            if name in whole:
                version.put_whole(f"warehouse_{name}", tables.with_parsed_times(whole[name], columns))
            else:
                rows = rows_of_run(version, name, own[name])
                version.put(f"warehouse_{name}", tables.with_parsed_times(rows, columns))
    except Exception as problem:
        log.exception("export warehouse failed; the run goes on")
        failed["warehouse"] = str(problem)
    return failed


def rows_of_run(version: Version, name: str, schema: T.StructType) -> DataFrame:
    """The rows that the run has put into a table."""
    folder = version.parts[name][version.run]
    return version.spark.read.schema(schema).parquet(f"{version.root}/{folder}")


def refresh_rollups(version: Version, days: list[dt.date] | None) -> dict[str, DataFrame]:
    """Recompute the five rollups for ``days`` (all days for None) and replace those days, also
    where nothing is left of one. Only the day folders of articles and bridges are read."""
    fresh = rollup.rollup_all(
        version.read("articles", schemas.ARTICLES),
        version.read("article_topic", LINKED_TOPIC),
        version.read("article_entity", LINKED_ENTITY),
        days,
    )
    for name, df in fresh.items():
        version.put_days(
            name, lambda at, df=df: df.hint("rebalance", "day").write.partitionBy("day").parquet(at), days
        )
    return {name: version.read(name, schema) for name, schema in ROLLUP_SCHEMAS.items()}


def run_backfill(
    spark: SparkSession,
    root: str,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
) -> dict[str, DataFrame]:
    """Rebuild the rollups of a range of days, or of everything, and publish them."""
    version = Version.open(spark, root, "backfill")
    days = None
    if start is not None or end is not None:
        stored = [version.read("articles", schemas.ARTICLES)]
        stored += [version.read(name, schema) for name, schema in ROLLUP_SCHEMAS.items()]
        held = reduce(DataFrame.union, [date_range(rows, start, end).select("day") for rows in stored])
        days = sorted(r["day"] for r in held.distinct().collect())
    made = refresh_rollups(version, days)
    version.publish()
    return made
