"""Scalar expressions (H), classification and entity jobs (I), dimension builds (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import classify, dims, entities, geo, ingest
from .frames_of import export_frame, news_classified, text_list
from .registry import query
from .sql import any_of, fold, kind, norm, pct, topic_list, week
from .views import NEWS_OPPORTUNITY, NEWS_RISK, NEWS_TOPICS


@query("h1_normalize_text", f"select doc_id, md5({norm('text')}) as h from documents")
def h1(t):
    return t("documents").select("doc_id", F.md5(text.normalize_text("text")).alias("h"))


@query("h2_normalize_key", f"""
    select conv_id, turn, md5({fold('trim(text)')}) as h from conversations""")
def h2(t):
    return t("conversations").select("conv_id", "turn", F.md5(text.normalize_key("text")).alias("h"))


@query("h3_fold", f"select doc_id, md5({fold('text')}) as h from documents")
def h3(t):
    return t("documents").select("doc_id", F.md5(text.fold("text")).alias("h"))


_PLAIN = r"""trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(html, '<[^>]+>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '),
        '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
    '[\s\p{Z}]+', ' ', 'g'))"""


@query("h4_strip_html", f"""
    select page_id, md5(regexp_replace({_PLAIN}, '&amp', '&', 'g')) as h,
           length(regexp_replace({_PLAIN}, '&amp', '&', 'g')) as n from pages""")
def h4(t):
    plain = t("pages").select("page_id", text.strip_html("html").alias("p"))
    return plain.select("page_id", F.md5("p").alias("h"), F.length("p").cast("bigint").alias("n"))


@query("h5_clean_mentions", r"""
    select p_partkey, array_to_string(list_filter(
        [trim(regexp_replace(replace(p_name, ' ', ' ##'), '\s*##', '', 'g')), trim(p_brand), '#x', 'a'],
        lambda m: length(m) >= 2 and not starts_with(m, '#')), '|') as names from part""")
def h5(t):
    raw = F.array(
        F.replace("p_name", F.lit(" "), F.lit(" ##")), F.col("p_brand"), F.lit("#x"), F.lit("a"))
    return t("part").select("p_partkey", F.array_join(text.usable_mentions(raw), "|").alias("names"))


@query("h6_classification_text", """
    select feed, pos, case when trim(description) = '' then title else description end as chosen
    from feed_entries""")
def h6(t):
    return t("feed_entries").select(
        "feed", "pos", text.classification_text("title", "description").alias("chosen"))


@query("h7_risk_text", """
    select feed, pos, title || ' ' || coalesce(nullif(description, ''), '') as joined from feed_entries""")
def h7(t):
    entries = t("feed_entries").withColumn("description", F.nullif("description", F.lit("")))
    return entries.select("feed", "pos", text.risk_text("title", "description").alias("joined"))


@query("h8_signal_kind", f"select id, {kind()} as kind from articles")
def h8(t):
    return t("articles").select("id", text.signal_kind().alias("kind"))


@query("h9_feed_day", f"""
    select event_id, case when event_type in ('click', 'error') then cast(ts as date)
        else date '2024-03-01' end as day from events""")
def h9(t):
    mail = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    short = F.date_format("ts", "d MMM yyyy HH:mm")
    raw = (
        F.when((F.col("event_type") == "click") & (F.col("event_id") % 4 == 0), mail)
        .when((F.col("event_type") == "click") & (F.col("event_id") % 4 == 1),
              F.date_format("ts", "EEE, dd MMM yy HH:mm:ss 'GMT'"))
        .when((F.col("event_type") == "click") & (F.col("event_id") % 4 == 2),
              F.date_format("ts", "EEEE, dd-MMM-yy HH:mm:ss 'GMT'"))
        .when(F.col("event_type") == "click", F.date_format("ts", "EEE MMM d HH:mm:ss yyyy"))
        .when(F.col("event_type") == "error", F.concat(short, F.lit(" -0600")))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "signup", "")
    )
    return t("events").select("event_id", dates.feed_day(raw, "2024-03-01").alias("day"))


@query("h10_lenient_date", """
    select event_id, case when event_type in ('signup', 'purchase') then null else cast(ts as date) end
        as day from events""")
def h10(t):
    raw = (
        F.when(F.col("event_type") == "click", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'garbage'"))
        .when(F.col("event_type") == "signup", "31/31/2024")
    )
    return t("events").select("event_id", dates.lenient_date(raw).alias("day"))


@query("h11_date_text", """
    select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, strftime(o_orderdate, '%d/%m') as short
    from orders""")
def h11(t):
    return t("orders").select("o_orderkey", dates.month_key("o_orderdate").alias("month"),
                              F.date_format("o_orderdate", "dd/MM").alias("short"))


@query("h12_week_key", f"select l_orderkey, l_linenumber, {week('l_shipdate')} as week from lineitem")
def h12(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", dates.week_key(F.to_date("l_shipdate")).alias("week"))


@query("h13_days_before", """
    select o_orderkey, cast(o_orderdate as date) - 84 as weeks12, cast(o_orderdate as date) - 372 as months12
    from orders""")
def h13(t):
    day = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", dates.days_before(day, 84).alias("weeks12"),
                              dates.days_before(day, 372).alias("months12"))


@query("h14_defaults", """
    select id, coalesce(region_id, -1) as region_id, coalesce(geo_level, 'indeterminado') as geo_level
    from articles""")
def h14(t):
    return t("articles").select(
        "id", F.coalesce("region_id", F.lit(-1)).cast("bigint").alias("region_id"),
        F.coalesce("geo_level", F.lit("indeterminado")).alias("geo_level"))


@query("h15_percent_change", f"""
    select l_orderkey, l_linenumber, {pct('l_quantity', '(l_quantity - l_linenumber * 5)')} as pct1,
           {pct('l_quantity', '(l_quantity - l_linenumber * 5)', 0)} as pct0 from lineitem""")
def h15(t):
    cur, prev = F.col("l_quantity"), F.col("l_quantity") - F.col("l_linenumber") * 5
    return t("lineitem").select("l_orderkey", "l_linenumber",
                                dates.percent_change(cur, prev, 1).alias("pct1"),
                                dates.percent_change(cur, prev, 0).alias("pct0"))


@query("h16_split_list", """
    select id, array_to_string(list_filter(list_transform(string_split(orgs_text || ', ,' || places_text, ','),
        lambda x: trim(x)), lambda x: x <> ''), '|') as names,
        array_to_string(list_filter(string_split(topics_text, '|'), lambda x: x <> ''), ',') as topics
    from export_rows""")
def h16(t):
    both = F.concat_ws(", ,", "orgs_text", "places_text")
    return t("export_rows").select("id", F.array_join(text.split_list(both), "|").alias("names"),
                                   text.join_list(text.split_list("topics_text", "|")).alias("topics"))


@query("h17_shorten", """
    select doc_id, case when length(t) <= 90 then t else
        rtrim(regexp_replace(substr(t, 1, 90), ' [^ ]*$', ''), ',;:') || '…' end as headline
    from (select doc_id, replace(text, chr(10), ' ') as t from documents) d""")
def h17(t):
    flat = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    return flat.select("doc_id", text.shorten("t", 90).alias("headline"))


@query("h17_topic_label", """
    select distinct topic, case topic when 'inversion' then 'Inversión' when 'industria' then 'Industria'
      when 'energia' then 'Energía' when 'aranceles' then 'Aranceles' else 'Tema Nuevo' end as label
    from export_topics""")
def h17b(t):
    topics = export_frame(t).select(F.explode("topics").alias("topic")).distinct()
    return topics.select("topic", text.topic_label("topic").alias("label"))


@query("h18_source_place", r"""
    select distinct source, nullif(trim(regexp_replace(lower(trim(
        substr(source, position('Google News - ' in source) + 14))), '\s+coahuila$', '')), '') as place
    from local_news where contains(source, 'Google News - ')
    union select distinct source, null from local_news where not contains(source, 'Google News - ')""")
def h18(t):
    return t("local_news").select("source").distinct().select("source", text.source_place("source").alias("place"))


@query("h19_model_answers", """
    select id, trim(persons_text) as persons, trim(split_part(orgs_text, ',', 1)) as orgs,
           '' as places from export_rows""")
def h19(t):
    item = F.struct(
        F.lit(1).alias("id"), F.array(F.trim("persons_text")).alias("personas"),
        F.array(F.trim(F.split_part("orgs_text", F.lit(","), F.lit(1)))).alias("organizaciones"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.array(item)), F.lit("\n```"))
    parsed = entities.parse_model_answers(t("export_rows").select("id", fenced.alias("answer")))
    return parsed.select("id", *[text_list(c) for c in ("persons", "orgs", "places")])


@query("h20_title_case", """
    select p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
        lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') || ' O''X-Yz_W3K' as shown from part""")
def h20(t):
    name = F.concat("p_name", F.lit(" o'x-yZ_w3k"))
    return t("part").select("p_partkey", text.title_case(name).alias("shown"))


# --- I --------------------------------------------------------------------------------


@query("i1_topic_classification", f"""
    select id, array_to_string(found, ',') as topics, cast(len(found) as int) as score,
           case when len(found) > 0 then 1 else 0 end as relevant
    from (select id, {topic_list('t')} as found from (select id,
        {norm("case when trim(description) = '' then title else description end")} as t from news) x) y""")
def i1(t):
    rows = classify.classify_topics(t("news"), NEWS_TOPICS)
    return rows.select("id", text_list("topics"), "score", "relevant")


@query("i2_reclassify_all", """
    select id as article_id, unnest(string_split(topics, ',')) as name from news_classified
    where topics <> ''""")
def i2(t):
    return news_classified(t).select(F.col("id").alias("article_id"), F.explode("topics").alias("name"))


@query("i3_signals", f"""
    select id, case when relevant = 1 and {any_of('s', NEWS_RISK)} then 1 else 0 end as risk,
           case when relevant = 1 and {any_of('s', NEWS_OPPORTUNITY)} then 1 else 0 end as opportunity
    from (select d.doc_id as id, coalesce(quality, 0) as relevant,
            {fold("trim(split_part(text, chr(10), 1)) || ' ' || text")} as s
          from documents d left join labels l on d.doc_id = l.doc_id) x""")
def i3(t):
    marks = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("relevant"))
    rows = t("news").join(marks, "id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    return classify.classify_signals(rows, NEWS_RISK, NEWS_OPPORTUNITY).select("id", "risk", "opportunity")


@query("i4_gazetteer", """
    select id as article_id, surface, kind, cast(first_pos as int) as pos from (
        select a.id, g.surface, g.kind,
            min(case when array_to_string(list_slice(words, p, p + nw - 1), ' ') = gram then p end)
                as first_pos
        from (select id, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9_]+'),
                     lambda w: w <> '') as words from articles) a,
             (select surface, kind, lower(surface) as gram, len(string_split(surface, ' ')) as nw
              from (select n_name as surface, 'LOC' as kind from nation
                    union select c_mktsegment || ' order', 'ORG' from customer
                    union select 'priority 1', 'MISC') s) g,
             unnest(range(1, len(words) + 1)) as r(p)
        group by a.id, g.surface, g.kind) h where first_pos is not null""")
def i4(t):
    gazetteer = t.sql("""select n_name as surface, 'LOC' as kind from nation""").union(
        t.sql("select distinct c_mktsegment || ' order' as surface, 'ORG' as kind from customer")
    ).union(t.sql("select 'priority 1' as surface, 'MISC' as kind from region").distinct())
    return entities.extract_by_gazetteer(t("articles"), gazetteer)


_KEY = fold("trim(surface)")
_FIRST = f"""select key, surface, kind from (
    select {_KEY} as key, surface, kind, row_number() over (
        partition by {_KEY} order by article_id, pos) as rn from name_mentions) f
    where rn = 1 and key <> ''"""
_RESOLVED = f"""select f.key, f.surface as name, f.kind, coalesce(a.entity_id, e.id) as known_id
    from ({_FIRST}) f left join known_aliases a on f.key = a.alias
    left join known_entities e on f.surface = e.name"""


@query("i5_entity_resolution", f"""
    select key, name, kind, known_id, case when known_id is null then 1 else 0 end as is_new
    from ({_RESOLVED}) r""")
def i5(t):
    r = entities.resolve_keys(t("name_mentions"), t("known_aliases"), t("known_entities"))
    return r.select("key", "name", "kind", F.when(F.col("is_new") == 0, F.col("entity_id")).alias("known_id"),
                    "is_new")


_FOREIGN = ["nation_1", "nation_7"]
_HOME = ["nation_3"]
_STATES = ["nation_2", "nation_3", "nation_5"]


def _in_places(terms: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in terms)
    return (f"len(list_intersect(list_transform(string_split(places_text, ','), "
            f"lambda p: lower(trim(p))), [{listed}])) > 0")


_GEO = f"""case when {_in_places(_FOREIGN)} or {any_of('lower(title)', _FOREIGN)} then 'internacional'
    when {_in_places(_HOME)} or {any_of('lower(title)', _HOME)} then 'estatal'
    when {_in_places(_STATES)} or {any_of('lower(title)', _STATES)} then 'nacional'
    else 'indeterminado' end"""
_COMPANIES = ["building", "nation_2 "]
_DEEP = f"""case when {any_of("lower(orgs_text)", _COMPANIES)} or {_in_places(_FOREIGN)} then 1 else 0 end"""


@query("i6_geo_level", f"select id, {_GEO} as geo_level from export_rows")
def i6(t):
    return geo.with_geo_level(export_frame(t), _FOREIGN, _HOME, _STATES).select("id", "geo_level")


@query("i7_deep_analysis", f"select id, {_DEEP} as deep_analysis from export_rows")
def i7(t):
    return export_frame(t).select(
        "id", geo.deep_analysis("places", "orgs", _COMPANIES, _FOREIGN).alias("deep_analysis"))


@query("i8_region_id", """
    select id, (select max(r.id) from regions r where name_norm = lower(trim(split_part(places_text, ',', 1))))
        as region_id from export_rows""")
def i8(t):
    return geo.with_region(export_frame(t), t("regions")).select("id", "region_id")


@query("i9_article_results", f"""
    select e.id, array_to_string(list_filter(list_transform(string_split(orgs_text, ','),
        lambda x: trim(x)), lambda x: x <> ''), ',') as orgs, {_GEO} as geo_level,
        r.id as region_id, {_DEEP} as deep_analysis
    from export_rows e left join regions r on name_norm = lower(trim(split_part(places_text, ',', 1)))""")
def i9(t):
    rows = geo.with_geo_level(
        geo.with_region(export_frame(t), t("regions")), _FOREIGN, _HOME, _STATES)
    return rows.select("id", text_list("orgs"), "geo_level", "region_id",
                       geo.deep_analysis("places", "orgs", _COMPANIES, _FOREIGN).alias("deep_analysis"))


@query("i9_entity_links", f"""
    select distinct article_id, key from (
        select article_id, {_KEY} as key from name_mentions) m""")
def i9b(t):
    r = entities.resolve_keys(t("name_mentions"), t("known_aliases"), t("known_entities"))
    links = entities.entity_links(t("name_mentions"), r)
    return links.join(r, "entity_id").select("article_id", "key")


# --- J --------------------------------------------------------------------------------


@query("j1_build_topics", """
    select grp as name, case grp when 'PROMO' then 'ofertas' else '' end as description,
           string_agg(term, ',' order by ord) as keywords, min(ord) as ord
    from (select grp, term, min(ord) as ord from keyword_rows group by grp, term) k group by grp""")
def j1(t):
    rows = t("keyword_rows").withColumnRenamed("grp", "group")
    unique = rows.groupBy("kind", "group", "term").agg(F.min("ord").alias("ord"))
    return dims.build_topics(unique, {"PROMO": "ofertas"})


@query("j2_build_regions", """
    select name, lower(name) as name_norm, kind, country, is_target, min(ord) as ord from (
        select array_to_string(list_transform(string_split(lower(s_name), ' '),
                 lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as name, 'estado' as kind,
               'Mexico' as country, case when lower(s_name) = 'supplier#000000007' then 1 else 0 end as is_target,
               cast(s_suppkey as int) as ord from supplier
        union all
        select case when p_brand = 'Brand#1' then 'Marca Uno' else p_brand end, 'pais',
               case when p_brand = 'Brand#1' then 'Marca Uno' else p_brand end, 0, cast(p_partkey as int)
        from part) r group by 1, 2, 3, 4, 5""")
def j2(t):
    states = t.sql("select s_name as term, cast(s_suppkey as int) as ord from supplier")
    countries = t.sql("select p_brand as term, cast(p_partkey as int) as ord from part")
    built = dims.build_regions(states, countries, home_state="supplier#000000007",
                               labels={"brand#1": "Marca Uno"})
    return built.drop("block")


@query("j3_key_entities", """
    select entity_id, alias, case when pos = 0 then 1 else 0 end as is_primary from (
        select entity_id, alias, pos, row_number() over (partition by alias order by entity_id, pos) as rn
        from (select p_partkey as entity_id, lower(p_brand) as alias, 1 as pos from part
              union all select p_partkey, lower(p_name) || ' ' || cast(p_size as string), 0 from part) a) b
    where rn = 1""")
def j3(t):
    companies = t.sql("""select p_partkey as ord, p_name || ' #' || cast(p_partkey as string) as canonical,
        p_type as category, p_name || ' ' || cast(p_size as string) as a0, p_brand as a1 from part""")
    _, aliases = dims.build_key_entities(companies.withColumn("aliases", F.array("a0", "a1")))
    return aliases


_TOPIC_TABLE = """select p_brand as name, min(p_partkey) as id from part group by p_brand"""


@query("j4_topic_bridge_from_text", f"""
    select distinct article_id, k.id as topic_id from (
        select l_orderkey as article_id, trim(unnest(string_split(p_brand || ', ' || p_type, ','))) as name
        from lineitem join part on l_partkey = p_partkey) n join ({_TOPIC_TABLE}) k on n.name = k.name""")
def j4(t):
    legacy = t.sql("""select l_orderkey as id, p_brand || ', ' || p_type as topics
                      from lineitem join part on l_partkey = p_partkey""")
    return classify.topic_names_from_text(legacy, t.sql(_TOPIC_TABLE))


@query("j5_entities_from_text", """
    select key, name, kind from (
        select lower(surface) as key, surface as name, kind, row_number() over (
            partition by lower(surface) order by article_id, block, pos) as rn from (
            select id as article_id, 0 as block, 1 as pos, 'PER' as kind, trim(persons_text) as surface
            from export_rows
            union all select id, 1, unnest([1, 2]), 'ORG',
                   trim(unnest(string_split(orgs_text, ','))) from export_rows
            union all select id, 2, unnest([1, 2]), 'LOC',
                   trim(unnest(string_split(rtrim(places_text, ','), ','))) from export_rows) m) k
    where rn = 1""")
def j5(t):
    legacy = t("export_rows").select("id", F.col("persons_text").alias("persons"),
                                     F.col("orgs_text").alias("orgs"), F.col("places_text").alias("places"))
    mentions = entities.legacy_mentions(legacy)
    none = t("known_entities").filter(F.lit(False))
    resolved = entities.resolve_keys(mentions, t("known_aliases").filter(F.lit(False)), none)
    return resolved.select("key", "name", "kind")


@query("j6_region_from_list", """
    select id, (select max(r.id) from regions r where name_norm = lower(trim(split_part(places_text, ',', 1))))
        as region_id from export_rows""")
def j6(t):
    legacy = t("export_rows").select("id", text.split_list("places_text").alias("places"))
    return geo.with_region(legacy, t("regions")).select("id", "region_id")


@query("j7_stage_status", """
    select id, case when source like '%AUTO%' then 1 else 0 end as topics_done,
           case when relevant = 1 then 1 else 0 end as entities_done, 1 as signals_done from articles""")
def j7(t):
    rows = t("articles").withColumns({
        "topics": F.when(F.col("source").contains("AUTO"), F.array("source")),
        "persons": F.when(F.col("relevant") == 1, F.array("source")),
    })
    return ingest.stage_status(rows).select("id", "topics_done", "entities_done", "signals_done")
