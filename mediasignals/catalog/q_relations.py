"""Joins (C), windows (E), ordering (F), set operations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text
from ..functions.matching import gram_pairs
from ..operators import classify, counts, dims, entities, frames, geo, ingest, listing, quality, rollup, trends
from ..session import shared_dir
from ..sources import tables
from .frames_of import (
    export_frame, local_frame, news_classified, rollup_of, text_list,
)
from .registry import query
from .sql import any_of, fold, kind, n_where, norm, pct
from .views import NEWS_OPPORTUNITY, NEWS_RISK, NEWS_TOPICS, STAR_AS_OF

_DAY = "date '1999-06-15'"


@query("c1_articles_by_topic", """
    select id, title, day, source, risk, opportunity from articles
    where id in (select article_id from article_topic join topics on topic_id = topics.id
                 where name = 'PROMO') and day >= date '1997-01-01'""")
def c1(t):
    return counts.articles_by_topic(
        t("articles"), t("article_topic"), t("topics"), "PROMO", start="1997-01-01")


@query("c2_entity_articles", """
    select entity_id, name, kind, article_id, day, role from article_entity
    join entities on entity_id = entities.id join articles on article_id = articles.id""")
def c2(t):
    return counts.entity_articles(t("articles"), t("article_entity"), t("entities"))


@query("c3_articles_with_region", """
    select a.id, a.day, a.region_id, r.name as region, r.kind as region_kind
    from articles a join regions r on a.region_id = r.id""")
def c3(t):
    rows = counts.articles_with_region(t("articles"), t("regions"))
    return rows.select("id", "day", "region_id", "region", "region_kind")


@query("c4_region_sentinel_join", """
    select day, region_id, geo_level, n_articles,
           case when region_id = -1 then 'Sin region' else coalesce(name, 'Sin region') end as region,
           case when region_id = -1 then geo_level else coalesce(name, geo_level) end as region_or_level
    from r_star left join regions on region_id = regions.id and region_id <> -1""")
def c4(t):
    named = counts.region_names(rollup_of(t, "daily_region"), t("regions"), lexicon.NO_REGION)
    both = counts.region_names(named.withColumnRenamed("region", "r1"), t("regions"), F.col("geo_level"))
    return both.select("day", "region_id", "geo_level", "n_articles", F.col("r1").alias("region"),
                       F.col("region").alias("region_or_level"))


@query("c5_article_topics_left", """
    select a.id, a.day, names as topics from articles a left join (
        select article_id, string_agg(name, '|' order by name) as names
        from article_topic join topics on topic_id = topics.id group by article_id) n
    on a.id = n.article_id where relevant = 1""")
def c5(t):
    rows = t("articles").withColumns(
        {c: F.lit("") for c in ("persons", "orgs", "places")})
    return counts.exported_articles(rows, t("article_topic"), t("topics")).select("id", "day", "topics")


@query("c6_top_entity_series", f"""
    select day, entity_id, name as entity, kind, mentions, n_risk, n_opportunity, freq_total
    from e_star join entities on entity_id = entities.id
    where entity_id in (select entity_id from e_star
        where day >= date '{STAR_AS_OF}' - 365
        group by entity_id order by sum(mentions) desc, entity_id limit 10)
    and day >= date '{STAR_AS_OF}' - 365""")
def c6(t):
    return counts.top_entity_series(rollup_of(t, "daily_entity"), t("entities"), STAR_AS_OF, 10, 365)


@query("c7_first_url_wins", """
    select id, url, source, day from news_unique
    where url not in (select 'doc://' || md5(text) from benchmark)""")
def c7(t):
    stored = t("benchmark").select(F.concat(F.lit("doc://"), F.md5("text")).alias("url"))
    return ingest.new_articles(t("news"), stored, "id").select("id", "url", "source", "day")


_KEYWORDS = """select distinct grp, term from (
        select case when t.active = 1 then 'active' else 'other' end as state, name as grp,
               lower(name) as term from topics t
        union all select 'x', 'von', 'von' union all select 'x', 'von', 'sch'
        union all select 'x', 'eau', 'eau') k"""


def _keyword_table(t):
    rows = t.sql(_KEYWORDS).select("grp", "term")
    return rows.select(F.lit("topic").alias("kind"), F.col("grp").alias("group"), "term",
                       F.lit(0).alias("ord"))


@query("c8_dictionary_join", f"""
    select id, string_agg(grp, ',' order by grp) as topics, cast(count(*) as int) as score from (
        select distinct id, grp from (select id,
            {norm("case when trim(description) = '' then title else description end")} as t from news) n
        join ({_KEYWORDS}) k on contains(t, term)) h group by id""")
def c8(t):
    hits = classify.classify_by_table(t("news"), _keyword_table(t))
    return hits.select("id", F.array_join(F.array_sort("topics"), ",").alias("topics"), "score")


@query("c8_gram_join", f"""
    select id as text_id, term as term_id from (select id, {norm('description')} as t from news) n
    join (select distinct term from ({_KEYWORDS}) k) d on contains(t, term)""")
def c8b(t):
    texts = t("news").select(F.col("id").alias("text_id"), text.normalize_text("description").alias("text"))
    terms = _keyword_table(t).select(F.col("term").alias("term_id"), "term").distinct()
    return gram_pairs(texts, terms)


@query("c9_alias_lookup", f"""
    select article_id, pos, surface, kind, {fold('trim(surface)')} as key, entity_id
    from name_mentions left join known_aliases on {fold('trim(surface)')} = alias""")
def c9(t):
    return entities.lookup_alias(t("name_mentions"), t("known_aliases")).select(
        "article_id", "pos", "surface", "kind", "key", "entity_id")


_REGION_OF = """
    select id, arg_min(region_id, pos) as region_id from (
        select e.id, pos, max(r.id) as region_id from (
            select id, unnest(string_split(places_text, ',')) as place,
                   generate_subscripts(string_split(places_text, ','), 1) as pos from export_rows) e
        join regions r on lower(trim(place)) = name_norm group by e.id, pos) p group by id"""


@query("c10_region_lookup", f"""
    select e.id, region_id from export_rows e left join ({_REGION_OF}) r on e.id = r.id""")
def c10(t):
    return geo.with_region(export_frame(t), t("regions")).select("id", "region_id")


@query("c10_region_join", f"""
    select e.id, region_id from export_rows e left join ({_REGION_OF}) r on e.id = r.id""")
def c10b(t):
    return geo.with_region(export_frame(t), t("regions")).select("id", "region_id")


_TOPIC_IDS = "select unnest(['t_ment', 't_sch', 't_cion']) as name, unnest([1, 2, 3]) as id"


@query("c11_topic_ids", f"""
    select n.id as article_id, cast(k.id as bigint) as topic_id, cast(1 as bigint) as score
    from (select id, unnest(string_split(topics, ',')) as name from news_classified) n
    join ({_TOPIC_IDS}) k on n.name = k.name""")
def c11(t):
    return classify.topic_links(news_classified(t), _news_topic_table(t))


def _news_topic_table(t):
    """Ids 1, 2, ... for the topics that occur, except the last one of the dictionary."""
    known = list(NEWS_TOPICS)[:-1]
    # rows of one url have one text and so the same topics: which of them stays does not matter
    scored = classify.classify(t("news"), NEWS_TOPICS, NEWS_RISK, NEWS_OPPORTUNITY)
    seen = scored.select(F.explode("topics").alias("name")).distinct()
    position = F.array_position(F.array(*[F.lit(n) for n in known]), F.col("name"))
    return seen.select(position.alias("id"), "name").filter("id > 0")


_SRC_PART = """select distinct source, trim(regexp_replace(lower(trim(
        substr(source, position('Google News - ' in source) + 14))), '\\s+coahuila$', '')) as part
    from local_news where contains(source, 'Google News - ')"""

_BY_SOURCE = f"""
    select source, arg_min(municipality, rk) as municipality, arg_min(subregion, rk) as subregion
    from (select source, municipality, subregion,
                 case when lower(municipality) = part then 0 else 100000 end + ord as rk
          from ({_SRC_PART}) s join municipalities
          on part <> '' and (contains(part, lower(municipality)) or contains(lower(municipality), part))) c
    group by source"""


@query("c12_source_municipality", _BY_SOURCE)
def c12(t):
    return geo.source_municipality(t("local_news"), t("municipalities"))


@query("c12_source_municipality_join", _BY_SOURCE)
def c12b(t):
    return geo.source_municipality(t("local_news"), t("municipalities"))


_BY_TITLE = """
    select id, arg_max(municipality, rk) as municipality, arg_max(subregion, rk) as subregion
    from (select id, municipality, subregion, length(municipality) * 1000 - ord as rk
          from local_news join municipalities on contains(lower(title), lower(municipality))) c
    group by id"""


@query("c13_title_municipality", _BY_TITLE)
def c13(t):
    return geo.title_municipality(t("local_news"), t("municipalities"), names=None)


@query("c13_title_municipality_join", _BY_TITLE)
def c13b(t):
    return geo.title_municipality(t("local_news"), t("municipalities"), names=None)


_MINING = any_of("lower(title)", lexicon.MINING_TERMS)
SUBREGION = f"""
    select n.id, coalesce(named, case when lower(geo_level) in ('estatal', 'nacional') and {_MINING}
           then 'Carbonífera' end) as subregion
    from local_news n left join (
        select id, arg_min(subregion, first_ord) as named from local_news
        join municipalities on contains(lower(title) || ' ' || lower(places_text), lower(municipality))
        join (select subregion as s, min(ord) as first_ord from municipalities group by 1) o
        on subregion = s group by id) h on n.id = h.id"""


@query("c14_subregion", SUBREGION)
def c14(t):
    return geo.with_subregion(local_frame(t), t("municipalities")).select("id", "subregion")


@query("c14_subregion_join", SUBREGION)
def c14b(t):
    rows = geo.with_subregion(local_frame(t), t("municipalities"))
    return rows.select("id", "subregion")


@query("c15_topic_names", """
    select day, topic_id, name as topic, n_articles, n_risk, n_opportunity, avg_score
    from t_star join topics on topic_id = topics.id""")
def c15(t):
    return counts.topic_names(rollup_of(t, "daily_topic"), t("topics"))


@query("c15_entity_names", """
    select day, entity_id, name as entity, kind, mentions, n_risk, n_opportunity, freq_total
    from e_star join entities on entity_id = entities.id""")
def c15b(t):
    return counts.entity_names(rollup_of(t, "daily_entity"), t("entities"))


# --- E --------------------------------------------------------------------------------


@query("e1_first_per_url", "select id, url from news_unique")
def e1(t):
    return ingest.first_per_key(t("news"), ["url"], ["id"]).select("id", "url")


@query("e2_previous_day", f"""
    select a.day, {pct('a.n_articles', 'b.n_articles')} as pct_n_articles,
           {pct('a.n_risk', 'b.n_risk')} as pct_n_risk,
           {pct('a.n_opportunity', 'b.n_opportunity')} as pct_n_opportunity
    from g_star a join g_star b on a.day = b.day + 1""")
def e2(t):
    return trends.day_over_day(rollup_of(t, "daily_global"))


@query("e3_headlines_per_topic", f"""
    select topic, cast(rank as int) as rank, id, source, day, risk, opportunity,
      case when length(title) <= 110 then title else
        rtrim(regexp_replace(substr(title, 1, 110), ' [^ ]*$', ''), ',;:') || '…' end as headline
    from (select *, row_number() over (partition by topic order by day desc, id) as rank
          from export_topics, last_day where day between d - 6 and d) r where rank <= 8""")
def e3(t):
    return frames.topic_headlines(frames.week_rows(export_frame(t)))


@query("e4_two_per_subregion", f"""
    select subregion, id, day, cast(rank as int) as rank from (
        select s.*, day, row_number() over (partition by subregion order by day desc, s.id) as rank
        from ({SUBREGION}) s join local_news n on s.id = n.id where subregion is not null) r
    where rank <= 2""")
def e4(t):
    rows = frames.subregion_articles(local_frame(t), t("municipalities"), 2)
    return rows.select("subregion", "id", "day", "rank")


_FIRST = """select *, row_number() over (partition by feed order by pos) as rank from feed_entries"""


@query("e5_first_entries", f"""
    select feed, pos, cast(rank as int) as rank from ({_FIRST}) r where rank <= 20""")
def e5(t):
    return quality.first_entries(t("feed_entries")).select("feed", "pos", "rank")


@query("e6_sample_titles", f"""
    select feed, string_agg(substr(title, 1, 80), '|' order by rank) as sample_titles from (
        select *, row_number() over (partition by feed order by rank) as k from ({_FIRST}) r
        where rank <= 20 and trim(title) <> '') s where k <= 3 group by feed""")
def e6(t):
    return quality.sample_titles(t("feed_entries")).select("feed", text_list("sample_titles", "|"))


# --- F --------------------------------------------------------------------------------


@query("f1_top_k", """
    select id, score, day from articles order by score desc, day desc, id limit 25""")
def f1(t):
    rows = t("articles").select("id", "score", "day")
    return rows.orderBy(F.desc("score"), F.desc("day"), "id").limit(25)


@query("f2_limit_offset", "select id, day from articles order by day desc, id desc limit 20 offset 60")
def f2(t):
    return listing.page(t("articles").withColumn("topics", F.lit("")), limit=20, offset=60).select("id", "day")


@query("f3_multi_key_sort", """
    select name, is_key, category from entities order by is_key desc, name, id limit 40""")
def f3(t):
    return listing.selectable_entities(t("entities"), 40).select("name", "is_key", "category")


@query("f4_highlighted", f"""
    select id, title, source, 'Sin tema' as topic, {kind()} as kind,
           coalesce(geo_level, 'Nacional') as region, url
    from articles where relevant = 1 and day = {_DAY} order by score desc, id limit 3""")
def f4(t):
    rows = t("articles").withColumn("topics", F.array().cast("array<string>"))
    return listing.highlighted(rows, "1999-06-15")


@query("f5_most_common", """
    select topic, count(*) as n from export_topics group by topic order by n desc, topic limit 3""")
def f5(t):
    hits = frames.exploded_topics(export_frame(t)).groupBy("topic").agg(F.count("*").alias("n"))
    return hits.orderBy(F.desc("n"), "topic").limit(3)


@query("f6_longest_key_first", """
    select id, arg_max(municipality, length(municipality) * 1000 - ord) as municipality
    from local_news join municipalities on contains(lower(title), lower(municipality)) group by id""")
def f6(t):
    return geo.title_municipality(t("local_news"), t("municipalities"), names=None).select(
        "id", "municipality")


# --- G --------------------------------------------------------------------------------


@query("g1_distinct_days", "select distinct day from articles where day is not null")
def g1(t):
    return rollup.days_with_data(t("articles"))


_MENTIONS = """
    select id as article_id, trim(name) as surface, kind from (
        select id, 'PER' as kind, unnest(string_split(persons_text, ',')) as name from export_rows
        union all
        select id, 'ORG', unnest(string_split(orgs_text, ',')) from export_rows
        union all
        select id, 'LOC', unnest(string_split(places_text, ',')) from export_rows) m
    where trim(name) <> ''"""


@query("g2_typed_mentions", _MENTIONS)
def g2(t):
    return entities.mentions_of(export_frame(t)).select("article_id", "surface", "kind")


@query("g3_add_links", """
    select article_id, entity_id from article_entity
    where article_id not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def g3(t):
    links = t("lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"))
    marked = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("article_id"))
    stored = links.join(marked.distinct(), "article_id")
    return classify.add_links(stored, links, ["article_id", "entity_id"])


@query("g4_replace_range", f"""
    select day, count(*) as n_articles from series
    where day < date '2024-01-20' group by day
    union all
    select day, {n_where('risk = 1')} from series where day >= date '2024-01-20' group by day
    having count(*) filter (risk = 1) > 0""")
def g4(t):
    path = shared_dir(t.spark, "by_day")
    every = t("series").groupBy("day").agg(F.count("*").alias("n_articles"))
    tables.replace_days(every, path)
    risky = t("series").filter("risk = 1 and day >= '2024-01-20'").groupBy("day").agg(
        F.count("*").alias("n_articles"))
    tables.replace_days(risky, path)
    return t.spark.read.schema("n_articles bigint, day date").parquet(path)


@query("g5_once_per_topic", """
    select distinct topic, id from export_topics""")
def g5(t):
    return frames.exploded_topics(export_frame(t), "id").select("topic", "id").distinct()


@query("g6_country_labels", """
    select name, min(ord) as ord from (
        select case when p_name like 'red%' then 'Rojo' else p_name end as name,
               cast(p_partkey as int) as ord from part) p group by name""")
def g6(t):
    terms = t.sql("""select case when p_name like 'red%' then 'red' else p_name end as term,
        cast(p_partkey as int) as ord from part""")
    shown = dims.build_regions(terms.filter(F.lit(False)), terms, labels={"red": "Rojo"})
    lowered = shown.filter("kind = 'pais'").select(
        F.when(F.col("name") == "Rojo", F.col("name")).otherwise(F.lower("name")).alias("name"), "ord")
    return lowered
