"""Geographic level, region, municipality and sub-region of an article."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text
from ..functions.matching import any_item_in, contains_any, gram_pairs
from ..functions.once import computed_once
from ..session import written

FOREIGN = [c for c in lexicon.COUNTRIES if c != lexicon.HOME_COUNTRY]


_BREAK = "\x00"


def _keys(items: str | Column) -> Column:
    """Lookup keys of the items. All are folded as one string: code inside a lambda is
    interpreted, so only the trimming stays there."""
    joined = F.array_join(F.col(items) if isinstance(items, str) else items, _BREAK)
    parts = F.split(text.fold(F.coalesce(joined, F.lit(""))), _BREAK)
    return F.transform(parts, text.strip_space)


def with_geo_level(
    articles: DataFrame,
    foreign: Sequence[str] = tuple(FOREIGN),
    home: Sequence[str] = (lexicon.HOME_STATE,),
    states: Sequence[str] = tuple(lexicon.STATES),
) -> DataFrame:
    """Adds ``geo_level``: other country > home state > any state; places by equality, title
    by containment. Title and places are folded once for all comparisons."""
    folded = computed_once(articles, _places=_keys("places"), _title=text.normalize_key("title"))

    def named(terms: Sequence[str]) -> Column:
        return any_item_in("_places", terms) | contains_any("_title", terms)

    level = (
        F.when(named(foreign), "internacional")
        .when(named(home), "estatal")
        .when(named(states), "nacional")
        .otherwise(lexicon.UNKNOWN_LEVEL)
    )
    return folded.withColumn("geo_level", level).drop("_places", "_title")


def deep_analysis(
    places: str | Column,
    orgs: str | Column,
    companies: Sequence[str] = tuple(lexicon.KEY_COMPANY_TERMS),
    foreign: Sequence[str] = tuple(FOREIGN),
) -> Column:
    """1 where an organisation contains a key-company term or a foreign country is named."""
    company = F.exists(_keys(orgs), lambda o: contains_any(o, companies))
    return (F.coalesce(company, F.lit(False)) | any_item_in(_keys(places), foreign)).cast("int")


def region_keys(regions: DataFrame) -> DataFrame:
    """(key, region_id): of regions sharing a key the one with the largest id counts."""
    named = regions.filter(F.length("name_norm") > 0)
    return named.groupBy(F.col("name_norm").alias("key")).agg(F.max("id").alias("region_id"))


def with_region(articles: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds ``region_id``: region of the first place that names one, else null."""
    lookup = region_keys(regions)
    places = articles.select("id", F.posexplode(_keys("places")).alias("pos", "key"))
    first = (
        places.join(lookup, "key").groupBy("id").agg(F.min_by("region_id", "pos").alias("region_id"))
    )
    return articles.join(first, "id", "left")


# --- municipalities -------------------------------------------------------------------


def municipality_keys(municipalities: DataFrame) -> DataFrame:
    """(key, ord, municipality, subregion): one row per folded, non-blank name, in file order."""
    keyed = municipalities.withColumn("key", text.fold(text.strip_space("municipality")))
    return keyed.filter(F.length("key") > 0).groupBy("key").agg(
        F.min("ord").alias("ord"),
        F.max_by("municipality", "ord").alias("municipality"),
        F.max_by("subregion", "ord").alias("subregion"),
    )


def keyword_variants(municipalities: DataFrame) -> DataFrame:
    """(ord, subregion, key): folded names plus the spelling without full stops."""
    usable = municipalities.filter(
        (F.coalesce(text.strip_space("municipality"), F.lit("")) != "")
        & (F.coalesce(text.strip_space("subregion"), F.lit("")) != "")
    )
    key = text.fold(text.strip_space("municipality"))
    bare = F.replace(F.replace(key, F.lit("."), F.lit("")), F.lit("  "), F.lit(" "))
    spellings = F.array_distinct(F.array(key, text.strip_space(bare)))
    return usable.select("ord", "subregion", F.explode(spellings).alias("key")).filter(F.length("key") > 0)


def source_municipality(sources: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Distinct ``source`` names -> (source, municipality, subregion).

    Exact key first, else the first municipality (file order) that contains the place part
    or is contained in it. Works on distinct names, never on articles.
    """
    parts = computed_once(sources.select("source").distinct(), part=text.source_place("source"))
    parts = parts.filter(F.col("part").isNotNull())
    dim = municipality_keys(municipalities)
    names = parts.select("part").distinct()
    inside = gram_pairs(
        names.select(F.col("part").alias("text_id"), F.col("part").alias("text")),
        dim.select(F.col("key").alias("term_id"), F.col("key").alias("term")),
    ).select(F.col("text_id").alias("part"), F.col("term_id").alias("key"))
    around = gram_pairs(
        dim.select(F.col("key").alias("text_id"), F.col("key").alias("text")),
        names.select(F.col("part").alias("term_id"), F.col("part").alias("term")),
    ).select(F.col("term_id").alias("part"), F.col("text_id").alias("key"))
    ranked = (
        inside.union(around)
        .join(dim, "key")
        .groupBy("part")
        .agg(
            F.min_by(
                F.struct("municipality", "subregion"),
                F.struct((F.col("key") != F.col("part")).cast("int").alias("near"), "ord"),
            ).alias("m")
        )
    )
    return parts.join(ranked, "part").select("source", "m.municipality", "m.subregion")


def title_municipality(
    articles: DataFrame,
    municipalities: DataFrame,
    names: Sequence[str] | None = tuple(lexicon.TITLE_MUNICIPALITIES),
) -> DataFrame:
    """(id, municipality, subregion) by the longest municipality name inside the title.

    ``names`` restricts the search to municipalities without a feed; None searches all.
    """
    dim = municipality_keys(municipalities)
    if names is not None:
        dim = dim.filter(F.arrays_overlap(F.array("key"), text.fold_all(names)))
    titles = computed_once(
        articles.select("id", "title"), text=F.coalesce(text.fold("title"), F.lit(""))
    ).select("id", "text")
    pairs = gram_pairs(
        titles.withColumnRenamed("id", "text_id"),
        dim.select(F.col("key").alias("term_id"), F.col("key").alias("term")),
    )
    ranked = pairs.join(dim.withColumnRenamed("key", "term_id"), "term_id").groupBy(
        F.col("text_id").alias("id")
    )
    best = ranked.agg(
        F.max_by(
            F.struct("municipality", "subregion"),
            F.struct(F.length("term_id"), -F.col("ord")),
        ).alias("m")
    )
    return best.select("id", "m.municipality", "m.subregion")


def attributed_articles(
    articles: DataFrame,
    municipalities: DataFrame,
    title_names: Sequence[str] | None = tuple(lexicon.TITLE_MUNICIPALITIES),
) -> DataFrame:
    """Articles with ``municipality`` and ``subregion``: by source, else by title.

    Articles of neither kind are left out.
    """
    by_source = source_municipality(articles, municipalities)
    keyed = articles.join(by_source, "source", "left")
    by_title = title_municipality(
        keyed.filter("subregion is null"), municipalities, title_names
    ).select("id", F.col("municipality").alias("_m"), F.col("subregion").alias("_s"))
    merged = keyed.join(by_title, "id", "left")
    return (
        merged.withColumn("municipality", F.coalesce("municipality", "_m"))
        .withColumn("subregion", F.coalesce("subregion", "_s"))
        .drop("_m", "_s")
        .filter("subregion is not null")
    )


# --- sub-regions ----------------------------------------------------------------------


def subregion_order(municipalities: DataFrame) -> DataFrame:
    """(subregion, ord) in order of first appearance."""
    return _first_ord(keyword_variants(municipalities))


def _first_ord(variants: DataFrame) -> DataFrame:
    return variants.groupBy("subregion").agg(F.min("ord").alias("ord"))


def with_subregion(
    articles: DataFrame,
    municipalities: DataFrame,
    mining_terms: Sequence[str] = tuple(lexicon.MINING_TERMS),
    mining_levels: Sequence[str] = tuple(lexicon.MINING_LEVELS),
    mining_subregion: str = lexicon.MINING_SUBREGION,
) -> DataFrame:
    """Adds ``subregion``: any municipality in title or places, first sub-region in order;
    else the mining sub-region for mining words in a state or national title."""
    variants = written(keyword_variants(municipalities), "variants")  # read three times
    places = F.array_join(F.coalesce("places", F.array().cast("array<string>")), ",")
    folded = articles.withColumn("_title", F.coalesce(text.fold("title"), F.lit("")))
    folded = folded.withColumn("_where", F.concat("_title", F.lit(" "), text.fold(places)))
    mining = F.when(
        text.fold("geo_level").isin(list(mining_levels)) & contains_any("_title", mining_terms),
        F.lit(mining_subregion),
    )
    pairs = gram_pairs(
        folded.select(F.col("id").alias("text_id"), F.col("_where").alias("text")),
        variants.select(F.col("key").alias("term_id"), F.col("key").alias("term")).distinct(),
    )
    first = (
        pairs.join(variants.select(F.col("key").alias("term_id"), "subregion"), "term_id")
        .join(_first_ord(variants), "subregion")
        .groupBy(F.col("text_id").alias("id"))
        .agg(F.min_by("subregion", "ord").alias("_named"))
    )
    return (
        folded.join(first, "id", "left")
        .withColumn("subregion", F.coalesce("_named", mining))
        .drop("_title", "_where", "_named")
    )
