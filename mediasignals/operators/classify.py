"""Topic, relevance, risk and opportunity classification. No shuffle anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text
from ..functions.matching import contains_any, matching_terms
from ..functions.once import computed_once
from .ingest import first_per_key

Topics = Mapping[str, Sequence[str]]


def topic_array(normalized: str | Column, topics: Topics, match: str = "substring") -> Column:
    """Names of the topics with a term in the text, in dictionary order."""
    hits = [
        F.when(contains_any(normalized, terms, match), F.lit(name))
        for name, terms in topics.items()
    ]
    return F.array_compact(F.array(*hits))


def _flags(risk_hit: Column, opportunity_hit: Column) -> dict[str, Column]:
    """Only relevant rows are evaluated; the others keep 0."""
    relevant = F.col("relevant") == 1
    return {
        "risk": F.when(relevant & risk_hit, 1).otherwise(0),
        "opportunity": F.when(relevant & opportunity_hit, 1).otherwise(0),
    }


def _scores() -> dict[str, Column]:
    score = F.size("topics")
    return {"score": score, "relevant": (score > 0).cast("int")}


def _lowered(terms: Sequence[str]) -> list[str]:
    return [t.lower() for t in terms]


def classify_topics(
    articles: DataFrame,
    topics: Topics = lexicon.TOPICS,
    match: str = "substring",
) -> DataFrame:
    """Adds ``topics``, ``score`` (number of topics) and ``relevant``.

    Terms are compared as written, so one with an accent or hyphen never matches.
    """
    prepared = articles.withColumn(
        "_text", text.normalize_text(text.classification_text("title", "description"))
    )
    matched = computed_once(prepared, topics=topic_array("_text", topics, match))
    return matched.withColumns(_scores()).drop("_text")


def classify_signals(
    articles: DataFrame,
    risk: Sequence[str] = lexicon.RISK_TERMS,
    opportunity: Sequence[str] = lexicon.OPPORTUNITY_TERMS,
    match: str = "substring",
) -> DataFrame:
    """Adds ``risk`` and ``opportunity``; only relevant rows are evaluated, others are 0."""
    prepared = articles.withColumn("_text", text.fold(text.risk_text("title", "description")))
    matched = computed_once(
        prepared,
        **_flags(
            contains_any("_text", _lowered(risk), match),
            contains_any("_text", _lowered(opportunity), match),
        ),
    )
    return matched.drop("_text")


def classify(
    articles: DataFrame,
    topics: Topics = lexicon.TOPICS,
    risk: Sequence[str] = lexicon.RISK_TERMS,
    opportunity: Sequence[str] = lexicon.OPPORTUNITY_TERMS,
    match: str = "substring",
) -> DataFrame:
    """Both classifications in one pass: title and description are folded once each."""
    folded = articles.select(
        "*", text.fold("title").alias("_title"), text.fold("description").alias("_description")
    )
    prepared = folded.select(
        "*",
        F.coalesce(
            text.blank_punctuation(text.classification_text("_title", "_description")), F.lit("")
        ).alias("_topic_text"),
        text.risk_text("_title", "_description").alias("_signal_text"),
    )
    matched = computed_once(
        prepared,
        topics=topic_array("_topic_text", topics, match),
        _risk=contains_any("_signal_text", _lowered(risk), match),
        _opportunity=contains_any("_signal_text", _lowered(opportunity), match),
    )
    scored = matched.withColumns(_scores())
    flagged = scored.withColumns(_flags(F.col("_risk"), F.col("_opportunity")))
    return flagged.drop(
        "_title", "_description", "_topic_text", "_signal_text", "_risk", "_opportunity"
    )


def topic_links(classified: DataFrame, topics: DataFrame) -> DataFrame:
    """Classified articles -> bridge rows (article_id, topic_id, score); unknown names vanish."""
    names = classified.select(F.col("id").alias("article_id"), F.explode("topics").alias("name"))
    return (
        names.join(topics.select(F.col("id").alias("topic_id"), "name"), "name")
        .select("article_id", "topic_id")
        .distinct()
        .withColumn("score", F.lit(1).cast("long"))
    )


def classify_by_table(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """Classification against a keyword table (group, term, ord) of any size.

    Returns (id, topics, score) for the articles with a hit; topics follow the smallest
    ``ord`` of their group.
    """
    texts = articles.select(
        F.col("id").alias("text_id"),
        text.normalize_text(text.classification_text("title", "description")).alias("text"),
    )
    terms = keywords.select(F.col("term").alias("term_id"), "term").distinct()
    order = keywords.groupBy("group").agg(F.min("ord").alias("group_ord"))
    groups = keywords.select("term", "group").distinct().join(order, "group")
    hits = matching_terms(texts, terms).join(
        groups.withColumnRenamed("term", "term_id"), "term_id"
    )
    # an article meets each group once, so the list is bounded by the number of groups
    per_article = hits.select("text_id", "group", "group_ord").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("group_ord", "group")))
    return per_article.groupBy(F.col("text_id").alias("id")).agg(
        F.transform(ordered, lambda s: s["group"]).alias("topics"),
        F.count("*").cast("int").alias("score"),
    )


def topic_names_from_text(articles: DataFrame, topics: DataFrame) -> DataFrame:
    """Bridge rows from a legacy comma list ``topics`` (text)."""
    names = articles.select(
        F.col("id").alias("article_id"), F.explode(text.split_list("topics")).alias("name")
    )
    return (
        names.join(topics.select(F.col("id").alias("topic_id"), "name"), "name")
        .select("article_id", "topic_id")
        .distinct()
    )


def add_links(stored: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore of bridge rows: only the links that are not stored yet."""
    order = [c for c in links.columns if c not in keys] or keys
    return first_per_key(links, keys, order).join(stored.select(*keys), keys, "left_anti")
