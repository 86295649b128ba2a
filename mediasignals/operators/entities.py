"""Mentions, entity extraction and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text
from ..functions.matching import word_list
from ..functions.once import computed_once
from ..session import written

KIND_COLUMNS = (("persons", "PER"), ("orgs", "ORG"), ("places", "LOC"))
#: bytes of names up to which every task gets all anchors of a gazetteer
ANCHOR_BYTES = 1 << 20


def _typed(column: str, kind: str) -> Column:
    names = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.transform(names, lambda n: F.struct(n.alias("surface"), F.lit(kind).alias("kind")))


def mentions_of(articles: DataFrame) -> DataFrame:
    """Typed mentions (article_id, pos, surface, kind): persons, then orgs, then places."""
    typed = F.concat(*[_typed(column, kind) for column, kind in KIND_COLUMNS])
    return articles.select(
        F.col("id").alias("article_id"), F.posexplode(typed).alias("pos", "m")
    ).select("article_id", "pos", "m.surface", "m.kind")


def legacy_mentions(articles: DataFrame) -> DataFrame:
    """The same from comma lists kept as text."""
    lists = [text.split_list(column).alias(column) for column, _ in KIND_COLUMNS]
    return mentions_of(articles.select("id", *lists))


def extract_by_gazetteer(articles: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Gazetteer names (surface, kind) standing as whole words in title or description.

    A name is anchored at the one of its words that the fewest places of the texts hold; each
    word of a text meets the anchors by an equi-join, and the name's other words are looked up at
    the places beside. The cost follows the text, whatever the length of the longest name. Word
    places of the texts are never copied to every task; anchors are, up to ``ANCHOR_BYTES`` of names.
    Returns (article_id, surface, kind, pos), one row per article and name, ``pos`` being the first
    occurrence.
    """
    whole = F.concat_ws(" ", "title", text.strip_html(F.coalesce("description", F.lit(""))))
    listed = computed_once(
        articles.select(F.col("id").alias("article_id"), whole.alias("_text")),
        _words=word_list(text.fold("_text")),
    )
    names = computed_once(
        gazetteer.select("surface", "kind"), _name=word_list(text.fold("surface"))
    ).filter(F.size("_name") > 0).distinct()
    spots = names.select("surface", "kind", "_name", F.posexplode("_name").alias("_at", "word"))
    spread = listed.select("article_id", F.posexplode("_words").alias("_place", "word"))
    # written first, so that Spark knows its size before it decides how all words of the texts meet it
    known = written(spots.select("word").distinct(), "name_words")
    # places of words of the names, for the counts and for the hits
    held = written(spread.join(known, "word", "left_semi"), "held_words")
    counts = held.groupBy("word").agg(F.count("article_id").alias("n"))
    anchors = written(
        spots.join(counts, "word", "left")
        .groupBy("surface", "kind", "_name")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_at", "word")).alias("least"))
        .filter("least.n > 0")
        .select("surface", "kind", "_name", "least._at", "least.word"),
        "anchors",
    )
    # Spark's own size check goes by files, and those of held words are far smaller than their rows
    # in memory: without these hints it copies all of them to the driver and every task
    size = anchors.agg(F.sum(F.octet_length("surface") + 16)).first()[0] or 0
    begin = F.col("_place") - F.col("_at")
    hits = (
        held.join(anchors.hint("broadcast" if size <= ANCHOR_BYTES else "merge"), "word")
        .select("article_id", "surface", "kind", "_name", begin.alias("_begin"))
        .filter("_begin >= 0")
    )
    alone = hits.filter(F.size("_name") == 1).select("article_id", "surface", "kind", "_begin")
    # the other words of a name are held words too: texts are not read again for them
    due = hits.filter(F.size("_name") > 1).select(
        "article_id", "surface", "kind", "_begin", F.size("_name").alias("_n"), F.posexplode("_name").alias("_i", "word")
    )
    longer = (
        due.withColumn("_place", F.col("_begin") + F.col("_i"))
        .join(held.hint("merge"), ["article_id", "_place", "word"])
        .groupBy("article_id", "surface", "kind", "_begin", "_n")
        .agg(F.collect_set("_i").alias("_met"))  # as many as the name has words, at most
        .filter(F.size("_met") == F.col("_n"))
        .select("article_id", "surface", "kind", "_begin")
    )
    return (
        alone.union(longer)
        .groupBy("article_id", "surface", "kind")
        .agg((F.min("_begin") + 1).alias("pos"))
    )


def mention_arrays(mentions: DataFrame) -> DataFrame:
    """Mentions -> one row per article with ``persons``, ``orgs``, ``places`` in text order."""
    spot = F.struct("pos", "surface")
    lists = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, spot))),
            lambda s: s["surface"],
        ).alias(column)
        for column, kind in KIND_COLUMNS
    ]
    unique = mentions.groupBy("article_id", "kind", "surface").agg(F.min("pos").alias("pos"))
    return unique.groupBy("article_id").agg(*lists)


def parse_model_answers(answers: DataFrame) -> DataFrame:
    """Stored raw model answers (id, answer) -> id, persons, orgs, places of the first item."""
    first = F.get(text.parse_model_answer("answer"), 0)
    empty = F.array().cast("array<string>")
    parsed = answers.select("id", first.alias("a"))
    return parsed.select(
        "id",
        *[
            F.coalesce(F.array_distinct(F.col(f"a.{field}")), empty).alias(column)
            for field, column in (
                ("personas", "persons"), ("organizaciones", "orgs"), ("lugares", "places"),
            )
        ],
    )


#: places of mentions inside an article that keep their order
_PLACES = 10**9


def first_mentions(mentions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(key, surface, kind) of the first mention of each key, by ``turn`` (smallest first, see
    ``turns``: article_id, turn), article and place.

    The order is one number of a fixed width, so its minimum is found by a hash aggregate that is
    combined before the shuffle; the surface and kind of the winner are fetched by key and order
    afterwards.
    """
    keyed = computed_once(mentions, key=text.normalize_key("surface")).filter("key <> ''")
    turn = F.lit(0).cast("decimal(9,0)")
    if turns is not None:
        keyed = keyed.join(turns, "article_id")
        turn = F.coalesce("turn", F.lit(999_999_999)).cast("decimal(9,0)")
    # turn, article and place side by side
    article = F.col("article_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = (turn * F.lit("100000000000000000000").cast("decimal(21,0)") + article).cast("decimal(29,0)")
    order = (place * F.lit(_PLACES).cast("decimal(10,0)")).cast("decimal(38,0)")
    keyed = keyed.withColumn("_order", (order + F.col("pos").cast("decimal(9,0)")).cast("decimal(38,0)"))
    first = keyed.groupBy("key").agg(F.min("_order").alias("_order"))
    # mentions of one article and place are the same mention
    return keyed.join(first, ["key", "_order"], "left_semi").select("key", "surface", "kind").dropDuplicates(["key"])


def resolve_keys(
    mentions: DataFrame, aliases: DataFrame, entities: DataFrame, turns: DataFrame | None = None
) -> DataFrame:
    """One row per distinct mention key: (key, entity_id, name, kind, is_new).

    Known alias -> its entity. Otherwise a new entity named and typed like the first
    mention of the key (in the order of ``first_mentions``); an existing entity of that very name is
    reused. Joins see each key once, however often it is mentioned. New ids are hashes of the key.
    """
    first = first_mentions(mentions, turns)
    # an alias or name listed twice counts for the smallest id
    by_alias = aliases.groupBy(F.col("alias").alias("key")).agg(F.min("entity_id").alias("alias_id"))
    by_name = entities.groupBy(F.col("name").alias("surface")).agg(F.min("id").alias("name_id"))
    joined = first.join(by_alias, "key", "left").join(by_name, "surface", "left")
    known = F.coalesce("alias_id", "name_id")
    return joined.select(
        "key",
        F.coalesce(known, F.xxhash64("key")).alias("entity_id"),
        F.col("surface").alias("name"),
        "kind",
        known.isNull().cast("int").alias("is_new"),
    )


def new_entities(resolved: DataFrame) -> DataFrame:
    return resolved.filter("is_new = 1").select(
        F.col("entity_id").alias("id"), "name", "kind",
        F.lit(0).alias("is_key"), F.lit(None).cast("string").alias("category"),
    )


def new_aliases(resolved: DataFrame) -> DataFrame:
    return resolved.filter("is_new = 1").select(
        "entity_id", F.col("key").alias("alias"), F.lit(1).alias("is_primary")
    )


def entity_links(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Bridge rows, one per article and entity."""
    keyed = mentions.select("article_id", text.normalize_key("surface").alias("key")).distinct()
    return (
        keyed.join(resolved.select("key", "entity_id"), "key")
        .select("article_id", "entity_id")
        .distinct()
        .select(
            "article_id", "entity_id",
            F.lit(lexicon.MENTION_ROLE).alias("role"), F.lit(1).cast("long").alias("freq"),
        )
    )


def lookup_alias(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions with the entity their key is an alias of, null where unknown."""
    keyed = mentions.withColumn("key", text.normalize_key("surface"))
    known = aliases.select(F.col("alias").alias("key"), "entity_id")
    return keyed.join(known, "key", "left")
