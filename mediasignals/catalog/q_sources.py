"""Scans, sources and sinks (A) and filters (B)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, text
from ..operators import counts, dims, frames, geo, ingest, listing, rollup
from ..plans import report
from ..session import shared_dir, written
from ..sources import feeds, reports, tables
from .frames_of import export_frame, news_classified, rollup_of, series_global
from .registry import query
from .sql import fold, kind, n_where, norm
from .views import NEWS_AS_OF, STAR_AS_OF, Tables

_ENTRY = rf"""select seq, trim(title) as title, trim(link) as url, source,
    case when summary <> '' then summary else coalesce(description, '') end as description,
    coalesce(cast(try_strptime(regexp_extract(published,
        '(\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}}) \d{{2}}:\d{{2}}', 1), '%d %b %Y') as date),
        date '{NEWS_AS_OF}') as day
    from raw_entries where trim(title) <> '' and trim(link) <> ''"""


def _entries(t: Tables):
    return ingest.article_rows(t("raw_entries"), NEWS_AS_OF)


@query("a1_feed_entries",
       f"select seq, title, url, source, day, md5(description) as description_md5 from ({_ENTRY}) e")
def a1(t):
    return _entries(t).select(
        "seq", "title", "url", "source", "day", F.md5("description").alias("description_md5")
    )


# one feed of each source and language; a broken line and one without a name for each language
_FEEDS = """(select distinct source as name, lang as kind, case when source < 'm' then 'norte' else 'sur' end as region
    from documents where source is not null and lang is not null) f"""


@query("a2_source_catalogue", f"""
    select 'kind' as chosen_by, name, kind, region from {_FEEDS} where kind = 'en'
    union all select 'region', name, kind, region from {_FEEDS} where region = 'norte'
    union all select 'tag', name, kind, region from {_FEEDS} where kind = 'de' and region = 'sur'
    union all select 'rejected', kind || ' {{"name":', null, null from {_FEEDS} group by kind
    union all select 'rejected', '{{"url":"u","kind":"' || kind || '"}}', null, null from {_FEEDS} group by kind""")
def a2(t):
    path = shared_dir(t.spark, "catalogue")
    rows = t.sql("""select distinct source, lang from documents where source is not null and lang is not null""")
    region = F.when(F.col("source") < "m", "norte").otherwise("sur")
    feed = F.struct(
        F.col("source").alias("name"), F.concat(F.lit("feed://"), "source").alias("url"), F.col("lang").alias("kind"),
        region.alias("region"), F.array("lang", F.concat("lang", F.lit("-"), region)).alias("tags"))
    langs = rows.select("lang").distinct()
    rows.select(F.to_json(feed).alias("value")).union(
        langs.select(F.concat("lang", F.lit(' {"name":')))
    ).union(langs.select(F.to_json(F.struct(F.lit("u").alias("url"), F.col("lang").alias("kind"))))).write.text(path)
    feeds_ = feeds.read_catalogue(t.spark, path)
    found = [
        feeds.feeds_matching(feeds_, **by).select(F.lit(name).alias("chosen_by"), "name", "kind", "region")
        for name, by in (("kind", {"kind": "en"}), ("region", {"region": "norte"}), ("tag", {"tag": "de-sur"}))
    ]
    none = F.lit(None).cast("string")
    rejected = feeds.catalogue_rejects(t.spark, path).select(
        F.lit("rejected"), "record", none.alias("kind"), none.alias("region"))
    return found[0].union(found[1]).union(found[2]).union(rejected)


@query("a3_dictionary_load", f"""
    select kind, grp as "group", {norm('term')} as term, min(ord) as first_ord
    from keyword_rows group by 1, 2, 3
    union all select 'rejected', null, '{{"kind": "topic", "group": "' || grp, null from keyword_rows group by grp""")
def a3(t):
    path = shared_dir(t.spark, "dictionary")
    rows = t("keyword_rows").withColumnRenamed("grp", "group")
    broken = rows.select(F.concat(F.lit('{"kind": "topic", "group": "'), "group")).distinct()
    rows.select(F.to_json(F.struct("kind", "group", "term", "ord")).alias("value")).union(broken).write.text(path)
    loaded = feeds.read_keywords(t.spark, path).groupBy(
        "kind", "group", text.normalize_text("term").alias("term")).agg(F.min("ord").alias("first_ord"))
    return loaded.union(feeds.keyword_rejects(t.spark, path).select(
        F.lit("rejected"), F.lit(None).cast("string"), "record", F.lit(None).cast("int")))


@query("a4_municipality_keys", f"""
    select key, min(ord) as ord, arg_max(municipality, ord) as municipality,
           arg_max(subregion, ord) as subregion
    from (select cast(c_custkey as int) as ord, c_name as municipality, c_mktsegment as subregion,
                 {fold('trim(c_name)')} as key from customer) k group by key""")
def a4(t):
    dim = t.sql("""select cast(c_custkey as int) as ord, c_name as municipality,
                          c_mktsegment as subregion from customer""")
    return geo.municipality_keys(dim)


@query("a4_keyword_variants", """
    select ord, subregion, key from (
        select cast(p_partkey as int) as ord, p_type as subregion,
               unnest(list_distinct([lower(p_brand) || '. ' || p_name,
                                     lower(p_brand) || ' ' || p_name])) as key from part) k""")
def a4b(t):
    dim = t.sql("""select cast(p_partkey as int) as ord, p_type as subregion,
                          p_brand || '. ' || p_name as municipality from part""")
    return geo.keyword_variants(dim)


@query("a5_table_scan", f"""
    select l_orderkey, l_partkey, cast(l_shipdate as date) as day from lineitem
    where l_shipdate >= timestamp '2000-06-01'""")
def a5(t):
    rows = t("lineitem").filter(F.col("l_shipdate") >= F.lit("2000-06-01").cast("timestamp_ntz"))
    return rows.select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"))


@query("a6_bound_query", """
    select o_orderpriority, count(*) as n, max(o_totalprice) as top from orders
    where o_orderdate >= date '1999-01-01' and o_custkey >= 100 and o_orderstatus = 'F'
    group by o_orderpriority""")
def a6(t):
    return tables.bound_query(
        t.spark,
        """select o_orderpriority, count(*) as n, max(o_totalprice) as top from {o}
           where o_orderdate >= :since and o_custkey >= :customer and o_orderstatus = :status
           group by o_orderpriority""",
        {"o": t("orders")}, since=dt.date(1999, 1, 1), customer=100, status="F",
    )


@query("a7_lenient_csv", f"""
    select id, day, source, title, url, geo_level, deep_analysis, risk, opportunity, {kind()} as kind
    from (select id, case when source = 'view' then null else day end as day, source, title,
                 '' as url, '' as geo_level, deep_analysis,
                 case when source = 'click' then 0 else risk end as risk,
                 case when source = 'signup' then 0 else opportunity end as opportunity
          from series) x""")
def a7(t):
    # text rows with bad numbers and three date shapes, written as CSV and read back
    mail = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    raw = t("series").select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("source") == "view", "not a date")
        .when(F.col("source") == "error", mail)
        .otherwise(F.col("day").cast("string")).alias("day"),
        "source", "title", F.lit(None).cast("string").alias("url"),
        *[F.lit("").alias(c) for c in ("persons", "orgs", "places", "geo_level")],
        F.col("deep_analysis").cast("string").alias("deep_analysis"),
        F.when(F.col("source") == "click", "n/a").otherwise(F.col("risk").cast("string")).alias("risk"),
        F.when(F.col("source") == "signup", "").otherwise(
            F.concat(F.col("opportunity").cast("string"), F.lit(".0"))).alias("opportunity"),
        F.lit("").alias("topics"),
    )
    path = shared_dir(t.spark, "dashboard")
    raw.write.option("header", True).option("escape", '"').csv(path)
    typed = frames.parse_dashboard_csv(reports.read_dashboard_csv(t.spark, path))
    return typed.drop("persons", "orgs", "places", "topics")


@query("a8_latest_report", """
    select day, 'total ' || cast(n_articles as string) as text from g_series
    where day = date '2024-01-30'""")
def a8(t):
    # one text file per day, named by the day
    path = shared_dir(t.spark, "reports")
    totals = series_global(t).select(
        "day", F.concat(F.lit("total "), F.col("n_articles").cast("string")).alias("text"))
    totals.write.partitionBy("day").text(path)
    latest = reports.latest_report(reports.read_reports(t.spark, path), "2024-02-01")
    return latest.select("day", F.btrim("text", F.lit("\n")).alias("text"))


@query("a9_signal_csv", f"""
    select day, source, title, topics, {kind()} as kind, score from news_classified
    where risk = 1 or opportunity = 1""")
def a9(t):
    path = shared_dir(t.spark, "signals")
    reports.write_signal_csv(news_classified(t), path)
    return reports.read_signal_csv(t.spark, path)


@query("a10_dashboard_export", """
    select a.id, day, source, title, url, geo_level, deep_analysis, risk, opportunity, names as topics
    from articles a left join (
        select article_id, string_agg(name, '|' order by name) as names
        from article_topic join topics on topic_id = topics.id group by article_id) n
    on a.id = n.article_id where relevant = 1""")
def a10(t):
    rows = t("articles").withColumns(
        {c: F.array().cast("array<string>") for c in ("persons", "orgs", "places")}
    )
    path = shared_dir(t.spark, "dashboard")
    reports.write_dashboard_csv(
        counts.exported_articles(rows, t("article_topic"), t("topics"), ordered=False), path, "year")
    back = frames.parse_dashboard_csv(reports.read_dashboard_csv(t.spark, path))
    return back.withColumns({c: F.nullif(c, F.lit("")) for c in ("topics", "geo_level")}).drop(
        "persons", "orgs", "places", "kind")


@query("a11_warehouse_reload", """
    select 'articles' as name, count(*) as n, max(day) as last_day from articles
    union all select 'topics', count(*), null from topics
    union all select 'article_topic', count(*), null from article_topic""")
def a11(t):
    frames_ = {
        "articles": t("articles").withColumn("day", F.col("day").cast("string")),
        "topics": t("topics"), "article_topic": t("article_topic"),
    }
    paths = tables.reload_warehouse(frames_, shared_dir(t.spark, "warehouse"))
    read = {n: t.spark.read.parquet(p) for n, p in paths.items()}
    parts = [
        df.agg(F.lit(n).alias("name"), F.count("*").alias("n"),
               (F.max(F.to_date("day")) if n == "articles" else F.lit(None).cast("date")).alias("last_day"))
        for n, df in read.items()
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("a12_replace_days", f"""
    select day, source, count(*) as n_articles, {n_where('relevant = 1')} as n_relevant,
           {n_where('risk = 1')} as n_risk, {n_where('opportunity = 1')} as n_opportunity
    from series where day < date '2024-01-11' or (day >= date '2024-01-21' and day <> date '2024-01-25')
    group by day, source""")
def a12(t):
    # load every day, then replace the days from 11 on; 11 to 20 and 25 come out empty
    path = shared_dir(t.spark, "daily_source")
    tables.replace_days(rollup.daily_source(t("series")), path)
    later = t("series").filter("day >= '2024-01-21' and day <> '2024-01-25'")
    replaced = [dt.date(2024, 1, d) for d in range(11, 31)]
    tables.replace_days(rollup.daily_source(later), path, requested=replaced)
    return tables.read_rollup(t.spark, path, schemas.DAILY_SOURCE)


@query("a13_payload_sink", f"""
    select day, n_articles, n_relevant, n_risk, n_opportunity, n_mixed, n_sources, best.url as top_url
    from g_news left join (
        select day as d, url from (
            select day, url, row_number() over (partition by day order by score desc, id) as rn
            from news_classified where relevant = 1) x where rn = 1) best on day = d""")
def a13(t):
    path = shared_dir(t.spark, "payload")
    none = F.lit(None)
    rows = news_classified(t).withColumns(
        {"deep_analysis": F.lit(0), "region_id": none.cast("long"), "geo_level": none.cast("string")})
    rows = written(rows, "news_rows")
    links = rows.select(F.col("id").alias("article_id"), F.explode("topics").alias("name"))
    topics = links.select(F.xxhash64("name").alias("id"), "name").distinct()
    made = rollup.rollup_all(
        rows, links.select("article_id", F.xxhash64("name").alias("topic_id"), F.lit(1).cast("long").alias("score")),
        t.spark.createDataFrame([], schemas.ARTICLE_ENTITY))
    payload = report.daily_payload(rows, made, topics, t("regions"), t.spark.createDataFrame([], schemas.ENTITIES))
    reports.write_payload(payload, path)
    names = ["n_articles", "n_relevant", "n_risk", "n_opportunity", "n_mixed", "n_sources"]
    return reports.read_payload(t.spark, path).select(
        "day", *[F.get_json_object("payload", f"$.metrics.{n}").cast("long").alias(n) for n in names],
        F.get_json_object("payload", "$.highlights[0].url").alias("top_url"))


# --- B --------------------------------------------------------------------------------

_PAGE = "id, title, day, source, url, risk, opportunity, geo_level"


@query("b1_page", f"""
    select {_PAGE}, (select count(*) from articles where risk = 1 and source ilike '%nation_1%') as total
    from articles where risk = 1 and source ilike '%nation_1%'
    order by day desc, id desc limit 50 offset 100""")
def b1(t):
    rows = t("articles").withColumn("topics", F.lit(""))
    return listing.page(rows, source="nation_1", signal="riesgo", limit=50, offset=100).drop("topics")


@query("b2_source_contains", "select id, source from articles where source ilike '%auto%'")
def b2(t):
    return listing.source_contains(t("articles"), "auto").select("id", "source")


@query("b3_pending_topics", """
    select doc_id as id from documents where doc_id not in (select doc_id from labels)""")
def b3(t):
    done = t("labels").select(F.col("doc_id").alias("id"))
    return ingest.pending_topics(t("news"), done).select("id")


@query("b3_pending_flag", """
    select d.doc_id as id from documents d left join labels l on d.doc_id = l.doc_id
    where coalesce(l.quality, 0) = 0""")
def b3b(t):
    flagged = t("documents").join(t("labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), "quality")
    return ingest.pending_flag(flagged, "quality").select("id")


@query("b4_pending_signals", """
    select id from articles where relevant = 1
    and id not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def b4(t):
    done = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return ingest.pending_signals(t("articles"), done).select("id")


@query("b5_pending_entities", """
    select id, day from articles where relevant = 1
    and id not in (select l_orderkey from lineitem where l_returnflag = 'R')
    order by day desc, id limit 300""")
def b5(t):
    done = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return ingest.pending_entities(t("articles"), done, 300).select("id", "day")


@query("b6_open_range", "select id, day from articles where day >= date '2000-05-01'")
def b6(t):
    return dates.date_range(t("articles"), start="2000-05-01").select("id", "day")


@query("b7_closed_range",
       "select id, day from articles where day between date '1998-03-01' and date '1998-09-30'")
def b7(t):
    return dates.date_range(t("articles"), "1998-03-01", "1998-09-30").select("id", "day")


@query("b8_last_days", f"""
    select id, day from articles where day >= date '{STAR_AS_OF}' - 90""")
def b8(t):
    return dates.last_days(t("articles"), STAR_AS_OF, 90).select("id", "day")


@query("b9_global_metrics", """
    select day, n_articles, n_relevant, n_risk, n_opportunity, n_mixed, n_sources from g_series
    where day = date '2024-01-15'""")
def b9(t):
    return counts.global_metrics(series_global(t), "2024-01-15")


@query("b10_signals", "select id from articles where risk = 1 or opportunity = 1")
def b10(t):
    return listing.signals(t("articles")).select("id")


@query("b11_multi_select", """
    select id, kind, geo_level from export_kinds where kind in ('RIESGO', 'MIXTO', 'NEUTRO')
    and geo_level in ('estatal', 'nacional') and deep_analysis = 1""")
def b11(t):
    return listing.chosen(export_frame(t), ["RIESGO", "MIXTO", "NEUTRO"], ["estatal", "nacional"],
                          True).select("id", "kind", "geo_level")


@query("b12_signal_subsets", """
    select 'risk' as part, count(*) as n from export_kinds where kind in ('RIESGO', 'MIXTO')
    union all select 'opportunity', count(*) from export_kinds where kind in ('OPORTUNIDAD', 'MIXTO')
    union all select 'deep', count(*) from export_kinds where deep_analysis = 1""")
def b12(t):
    rows = export_frame(t)
    subsets = {"risk": listing.risk_rows, "opportunity": listing.opportunity_rows, "deep": listing.deep_rows}
    parts = [f(rows).agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, f in subsets.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("b13_active_topics", "select id, name from topics where active = 1")
def b13(t):
    return listing.active_topics(t("topics")).select("id", "name")


@query("b14_selectable_entities",
       "select id, name, is_key from entities order by is_key desc, name, id limit 100")
def b14(t):
    return listing.selectable_entities(t("entities"), 100).select("id", "name", "is_key")


@query("b15_daily_series", "select * from g_star where day between date '1999-01-01' and date '1999-12-31'")
def b15(t):
    return counts.daily_series(rollup_of(t, "daily_global"), "1999-01-01", "1999-12-31")


@query("b15_daily_trend", f"""
    select * from g_star where day >= date '{STAR_AS_OF}' - 30""")
def b15b(t):
    return counts.daily_series(rollup_of(t, "daily_global"), as_of=STAR_AS_OF, days=30)


@query("b16_source_series", f"""
    select * from s_star where day >= date '{STAR_AS_OF}' - 30""")
def b16(t):
    return counts.source_series(rollup_of(t, "daily_source"), STAR_AS_OF, 30)


@query("b17_latest", f"""
    select id, day, source, title, risk, opportunity, {kind()} as kind from articles
    where day between date '1999-01-01' and date '2000-12-31' and geo_level = 'estatal'
    order by day desc, id desc limit 500""")
def b17(t):
    return listing.latest(t("articles"), "1999-01-01", "2000-12-31", "estatal").select(
        "id", "day", "source", "title", "risk", "opportunity", "kind")


@query("b18_table_view", """
    select id, strftime(day, '%Y-%m-%d') as day_text, kind, source, title,
           case when url <> '' then '[Ver](' || url || ')' else '' end as link, geo_level
    from export_kinds""")
def b18(t):
    return listing.table_view(export_frame(t))


@query("b19_risks_to_analyse", """
    select id, title, source, url from articles
    where risk = 1 and deep_analysis = 1 and day = date '1995-01-02'""")
def b19(t):
    return listing.risks_to_analyse(t("articles"), "1995-01-02")


@query("b20_relevant", "select id from articles where relevant = 1")
def b20(t):
    return listing.relevant(t("articles")).select("id")
