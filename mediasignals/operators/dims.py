"""Dimension builds: topics, regions, key entities and their aliases."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon, schemas
from ..functions import text


def _labels(mapping: Mapping[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(
        F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]), key
    )


def keyword_table(spark: SparkSession) -> DataFrame:
    """The fixed dictionaries as rows (kind, group, term, ord)."""
    groups = [("topic", g, ts) for g, ts in lexicon.TOPICS.items()]
    groups += [
        ("risk", "risk", [t.lower() for t in lexicon.RISK_TERMS]),
        ("opportunity", "opportunity", [t.lower() for t in lexicon.OPPORTUNITY_TERMS]),
        ("geo", "home_state", [lexicon.HOME_STATE]),
        ("geo", "state", lexicon.STATES),
        ("geo", "country", lexicon.COUNTRIES),
        ("geo", "company", lexicon.KEY_COMPANY_TERMS),
    ]
    rows = [(kind, group, term) for kind, group, terms in groups for term in terms]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schemas.KEYWORDS)


def municipality_table(spark: SparkSession) -> DataFrame:
    rows = [(m, s) for s, ms in lexicon.MUNICIPALITIES.items() for m in ms]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.MUNICIPALITIES)


def normalized_geo_terms(keywords: DataFrame) -> DataFrame:
    """Geographic terms are compared as keys; all other terms stay as written."""
    term = F.when(F.col("kind") == "geo", text.normalize_key("term")).otherwise(F.col("term"))
    return keywords.withColumn("term", term)


def build_topics(
    keywords: DataFrame, descriptions: Mapping[str, str] = lexicon.TOPIC_DESCRIPTIONS
) -> DataFrame:
    """(name, description, keywords, ord) per dictionary group, terms in dictionary order."""
    # a group's terms are a dictionary entry, not data rows
    terms = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda s: s["term"]
    )
    grouped = keywords.filter("kind = 'topic'").groupBy(F.col("group").alias("name"))
    return grouped.agg(
        F.array_join(terms, ",").alias("keywords"), F.min("ord").alias("ord")
    ).select(
        "name",
        F.coalesce(_labels(descriptions, F.col("name")), F.lit("")).alias("description"),
        "keywords", "ord",
    )


def add_missing(stored: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore by a unique key: the built rows that are not stored yet."""
    return built.join(stored.select(key), key, "left_anti")


def build_regions(
    states: DataFrame,
    countries: DataFrame,
    home_state: str = lexicon.HOME_STATE,
    labels: Mapping[str, str] = lexicon.COUNTRY_LABELS,
    country: str = "Mexico",
) -> DataFrame:
    """States (term, ord) and countries (term, ord) -> region rows without ids, in order.

    Country spellings sharing a display name count once. ``seq`` is states first, then
    countries, each in their own order.
    """
    key = text.normalize_key("term")
    state_rows = (
        states.groupBy(key.alias("name_norm"))
        .agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
        .select(
            text.title_case("term").alias("name"), "name_norm", F.lit("estado").alias("kind"),
            F.lit(country).alias("country"),
            (F.col("name_norm") == home_state).cast("int").alias("is_target"),
            F.lit(0).alias("block"), "ord",
        )
    )
    shown = countries.select(
        F.coalesce(_labels(labels, key), text.title_case("term")).alias("name"), "ord"
    )
    country_rows = (
        shown.groupBy("name")
        .agg(F.min("ord").alias("ord"))
        .select(
            "name", text.normalize_key("name").alias("name_norm"), F.lit("pais").alias("kind"),
            F.col("name").alias("country"), F.lit(0).alias("is_target"),
            F.lit(1).alias("block"), "ord",
        )
    )
    return state_rows.unionByName(country_rows)


def build_key_entities(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical, category, aliases ARRAY, ord) -> key entities and their aliases.

    The first company claiming an alias keeps it; a company's first alias is primary.
    """
    entities = companies.select(
        F.col("ord").cast("long").alias("id"), F.col("canonical").alias("name"),
        F.lit("ORG").alias("kind"), F.lit(1).alias("is_key"), "category",
    )
    spelled = companies.select(
        F.col("ord").cast("long").alias("entity_id"), F.posexplode("aliases").alias("pos", "alias")
    ).withColumn("alias", text.normalize_key("alias"))
    aliases = spelled.groupBy("alias").agg(
        F.min(F.struct("entity_id", "pos")).alias("first")
    ).select(
        F.col("first.entity_id").alias("entity_id"), "alias",
        (F.col("first.pos") == 0).cast("int").alias("is_primary"),
    )
    return entities, aliases


def company_table(spark: SparkSession) -> DataFrame:
    rows = [
        (i, name, sector, aliases)
        for i, (name, sector, aliases) in enumerate(lexicon.KEY_COMPANIES, start=1)
    ]
    return spark.createDataFrame(rows, "ord int, canonical string, category string, aliases array<string>")
