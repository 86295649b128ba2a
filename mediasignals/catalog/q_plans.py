"""Streaming (K), report datasets (M) and whole runs (N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import schemas
from ..operators import classify, entities, frames, rollup
from ..plans import daily, report
from ..session import shared_dir, written
from ..sources import reports, tables
from ..sources.publish import Version
from ..streaming import jobs
from .frames_of import export_frame, local_frame, rollup_of
from .q_relations import _TOPIC_IDS, SUBREGION, _news_topic_table
from .registry import query
from .sql import any_of, big, fold, n_where, norm, pct, topic_list
from .views import NEWS_AS_OF, NEWS_OPPORTUNITY, NEWS_RISK, NEWS_TOPICS


def _stream(t, name: str, max_files: int | None = None):
    # as a pattern, since a table is either one file or a folder of files
    return jobs.read_files(t.spark, f"{t.folder}/{{{name}}}.parquet", t(name).schema, max_files=max_files)


def _arriving(t, rows, order, steps: int):
    """Lets ``rows`` arrive in steps by a number column ``order``: the folder, after each step."""
    folder = shared_dir(t.spark, "arrivals")
    rows = written(rows.withColumn("_at", order), "to_arrive")
    low, high = rows.agg(F.coalesce(F.min("_at"), F.lit(0)), F.coalesce(F.max("_at"), F.lit(0))).first()
    size = (high - low) // steps + 1
    for i in range(steps):
        start = low + i * size
        part = rows.filter((F.col("_at") >= start) & (F.col("_at") < start + size)).drop("_at")
        # files by size: else each split of the table leaves a small one in every step, and a trigger
        # costs the same however small its file is
        part.hint("rebalance").write.parquet(f"{folder}/step={i}")
        yield f"{folder}/*"


def _windows(t, totals):
    """Windows over events that arrive in five steps; a third of the rows comes a day late and a
    third two days."""
    events = t("events")
    late = F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int")
    path, checkpoint = shared_dir(t.spark, "windows"), shared_dir(t.spark, "checkpoint")
    for folder in _arriving(t, events, F.unix_date(F.date_add(F.to_date("ts"), late)), 5):
        stream = jobs.read_files(t.spark, folder, events.schema)
        jobs.run_available(
            totals(_signals(stream), "ts", "3 days"), checkpoint,
            jobs.upsert(path, ["start_day", "end_day"], "start_day"), "update",
        ).awaitTermination()
    return t.spark.read.parquet(path).drop("day")


def _signals(events):
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"), kind.alias("source"),
        (kind != "view").cast("int").alias("relevant"),
        (kind == "error").cast("int").alias("risk"),
        (kind.isin("purchase", "signup") | (F.col("value") > 100)).cast("int").alias("opportunity"),
        (F.col("value") > 150).cast("int").alias("deep_analysis"),
    )


@query("k1_streamed_classification", f"""
    select id, array_to_string(found, ',') as topics, case when len(found) > 0 then 1 else 0 end as relevant,
      case when len(found) > 0 and is_risk then 1 else 0 end as risk,
      case when len(found) > 0 and is_opp then 1 else 0 end as opportunity
    from (select id, {topic_list('t')} as found, {any_of('s', NEWS_RISK)} as is_risk,
            {any_of('s', NEWS_OPPORTUNITY)} as is_opp
          from (select id, {norm('description')} as t, {fold("title || ' ' || description")} as s
                from news) x) y""")
def k1(t):
    articles = _stream(t, "documents", max_files=1).select(
        F.col("doc_id").alias("id"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("text").alias("description"))
    classified = classify.classify(articles, NEWS_TOPICS, NEWS_RISK, NEWS_OPPORTUNITY)
    out = classified.select("id", F.array_join("topics", ",").alias("topics"), "relevant", "risk", "opportunity")
    path = shared_dir(t.spark, "classified")
    jobs.run_available(out, shared_dir(t.spark, "checkpoint"), jobs.append_to(path)).awaitTermination()
    return t.spark.read.parquet(path).drop("batch")


@query("k2_streamed_dedup", "select id, url from news_unique")
def k2(t):
    rows = t("documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc://"), F.md5("text")).alias("url"))
    out, checkpoint = shared_dir(t.spark, "unique"), shared_dir(t.spark, "checkpoint")
    for folder in _arriving(t, rows, F.col("id"), 3):
        jobs.run_available(
            jobs.read_files(t.spark, folder, rows.schema), checkpoint, jobs.dedup_keyed(out, ["url"], "id")
        ).awaitTermination()
    return jobs.unique_rows(t.spark, out, rows.schema)


@query("k2_dedup_within_watermark", "select distinct event_type, cast(ts as date) as day from events")
def k2b(t):
    rows = _stream(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type", F.to_date("ts").alias("day"))
    unique = jobs.dedup_within(rows, "ts", "60 days", ["event_type", "day"]).select("event_type", "day")
    path = shared_dir(t.spark, "within")
    jobs.run_available(unique, shared_dir(t.spark, "checkpoint"), jobs.append_to(path)).awaitTermination()
    return t.spark.read.parquet(path).drop("batch")


_TOTALS = f"""count(*) as n_articles, {n_where("event_type = 'error'")} as n_risk,
    {n_where("event_type in ('purchase', 'signup') or value > 100")} as n_opportunity"""


@query("k3_tumbling_days", f"""
    select cast(ts as date) as start_day, cast(ts as date) as end_day, {_TOTALS} from events group by 1, 2""")
def k3(t):
    return _windows(t, jobs.tumbling_days)


@query("k3_touched_days", "select * from g_series")
def k3b(t):
    rows, out = shared_dir(t.spark, "rows"), shared_dir(t.spark, "daily_global")
    jobs.run_available(
        _signals(_stream(t, "events")), shared_dir(t.spark, "checkpoint"),
        jobs.recompute_touched_days(rows, out, rollup.daily_global),
    ).awaitTermination()
    return tables.read_rollup(t.spark, out, schemas.DAILY_GLOBAL)


@query("k4_sliding_weeks", f"""
    select d - 6 as start_day, d as end_day, {_TOTALS} from (
        select event_type, value, cast(ts as date) + cast(unnest(generate_series(0, 6)) as int) as d from events) w
    group by d""")
def k4(t):
    return _windows(t, jobs.sliding_weeks)


@query("k5_capped_triggers", """
    select l_returnflag, cast(date_trunc('month', l_shipdate) as date) as ship_month, count(*) as n
    from lineitem group by 1, 2""")
def k5(t):
    items = t("lineitem").select("l_returnflag", F.to_date(F.trunc("l_shipdate", "month")).alias("ship_month"))
    *_, folder = _arriving(t, items, F.month("ship_month"), 4)  # four steps have arrived before the first trigger
    counts = jobs.read_files(t.spark, folder, items.schema, max_files=1).groupBy(
        "l_returnflag", "ship_month").agg(F.count("*").alias("n"))
    path = shared_dir(t.spark, "capped")
    jobs.run_available(
        counts, shared_dir(t.spark, "checkpoint"),
        jobs.upsert(path, ["l_returnflag", "ship_month"], "ship_month"), "update",
    ).awaitTermination()
    return t.spark.read.parquet(path).drop("day")


# --- M --------------------------------------------------------------------------------

_TOP = """(select day, string_agg(label, ';' order by rk) as {name} from (
    select day, {label} as label, row_number() over (partition by day order by {order}) as rk
    from {rows}) x where rk <= {k} group by day)"""


@query("m1_daily_payload", f"""
    select g.day, g.n_articles, g.n_mixed, c.p as pct_n_articles, top_topics, top_regions, top_entities,
           highlights
    from g_star g left join (
        select a.day, {pct('a.n_articles', 'b.n_articles')} as p from g_star a join g_star b
        on a.day = b.day + 1) c on g.day = c.day
    left join {_TOP.format(name='top_topics', label="name || '=' || cast(n_articles as string)",
        order='n_articles desc, topic_id', rows='t_star join topics on topic_id = topics.id', k=3)} t
        on g.day = t.day
    left join {_TOP.format(name='top_regions',
        label="case when region_id = -1 then geo_level else coalesce(name, geo_level) end || '=' || cast(n_articles as string)",
        order='n_articles desc, region_id, geo_level',
        rows='r_star left join regions on region_id = regions.id and region_id <> -1', k=3)} r
        on g.day = r.day
    left join {_TOP.format(name='top_entities', label="name || '=' || cast(mentions as string)",
        order='mentions desc, entity_id', rows='e_star join entities on entity_id = entities.id', k=5)} e
        on g.day = e.day
    left join {_TOP.format(name='highlights', label="url", order='score desc, id',
        rows='(select * from articles where relevant = 1) z', k=3)} h on g.day = h.day""")
def m1(t):
    articles = t("articles").withColumn("topics", F.array().cast("array<string>"))
    made = {n: rollup_of(t, n) for n in rollup.ROLLUPS}
    p = report.daily_payload(articles, made, t("topics"), t("regions"), t("entities"))

    def listed(array: str, name: str, measure: str):
        return F.array_join(
            F.transform(array, lambda s: F.concat_ws("=", s[name], s[measure].cast("string"))), ";")

    none = F.lit(None).cast("string")
    return p.select(
        "day", "metrics.n_articles", "metrics.n_mixed", "change.pct_n_articles",
        listed("top_topics", "topic", "n_articles").alias("top_topics"),
        F.coalesce(listed("top_regions", "region", "n_articles"), none).alias("top_regions"),
        listed("top_entities", "entity", "mentions").alias("top_entities"),
        F.array_join(F.transform("highlights", lambda s: s["url"]), ";").alias("highlights"),
    )


_WEEK = "export_topics, last_day where day between d - 6 and d"


@query("m2_weekly_topic_totals", f"""
    select topic, count(*) as total, {big('sum(risk)')} as risks, {big('sum(opportunity)')} as opportunities
    from {_WEEK} group by topic""")
def m2(t):
    return report.weekly_report(export_frame(t), t("municipalities"))["topic_totals"]


@query("m2_weekly_subregions", f"""
    select o.subregion, cast(o.ord as int) as ord, {big('coalesce(n, 0)')} as n,
           {big('coalesce(risks, 0)')} as risks, {big('coalesce(opportunities, 0)')} as opportunities
    from (select subregion, min(ord) as ord from municipalities group by 1) o left join (
        select subregion, count(*) as n, sum(risk) as risks, sum(opportunity) as opportunities
        from ({SUBREGION}) s join local_news l on s.id = l.id, (select max(day) as d from local_news) m
        where day between d - 6 and d group by subregion) c
    on o.subregion = c.subregion""")
def m2b(t):
    return frames.subregion_stats(frames.week_rows(local_frame(t)), t("municipalities"))


@query("m3_outlook", f"""
    select subregion, n, 'La región ' || subregion || ' concentró la mayor actividad noticiosa esta semana con '
        || cast(n as string) || ' menciones.' as sentence from (
        select subregion, count(*) as n, min(first_ord) as o from ({SUBREGION}) s
        join (select subregion as sr, min(ord) as first_ord from municipalities group by 1) f on subregion = sr
        group by subregion) x order by n desc, o limit 1""")
def m3(t):
    return frames.outlook(frames.subregion_stats(local_frame(t), t("municipalities")))


# --- N --------------------------------------------------------------------------------


def _run(t) -> str:
    entries = t("news").select(
        "source", F.col("id").alias("seq"), "title", F.col("url").alias("link"),
        F.col("description").alias("summary"), F.lit(None).cast("string").alias("description"),
        F.date_format("day", "EEE, dd MMM yyyy 00:00:00 'GMT'").alias("published"))
    gazetteer = t.sql("select distinct source as surface, 'ORG' as kind from documents")
    topics = written(_news_topic_table(t), "topics")
    root = shared_dir(t.spark, "run")
    rules = daily.Rules(NEWS_TOPICS, NEWS_RISK, NEWS_OPPORTUNITY)
    daily.run_daily(t.spark, entries, root, NEWS_AS_OF, gazetteer, topics, t("regions"), rules)
    return root


_TOPIC_LINKS = f"""(select n.id as article_id, n.day, k.id as topic_id, n.risk
    from (select id, day, risk, unnest(string_split(topics, ',')) as name from news_classified) n
    join ({_TOPIC_IDS}) k on n.name = k.name)"""


# every table and export of the run: rows of a day and one sum
@query("n1_daily_run", f"""
    select 'articles' as name, day, count(*) as n, {big('sum(relevant)')} as m from news_classified group by day
    union all select 'article_topic', day, count(*), {big('sum(topic_id)')} from {_TOPIC_LINKS} l group by day
    union all select 'daily_global', day, n_articles, n_sources from g_news
    union all select 'daily_topic', day, count(*), {big('sum(risk)')} from {_TOPIC_LINKS} l group by day
    union all select 'daily_region', day, {n_where('relevant = 1')}, {big('sum(opportunity)')}
        from news_classified group by day having sum(relevant) > 0
    union all select 'daily_source', day, count(*), count(distinct source) from news_classified group by day
    union all select 'signals_csv', day, count(*), {big('sum(score)')} from news_classified
        where risk = 1 or opportunity = 1 group by day
    union all select 'dashboard_csv', day, count(*), {big('sum(risk)')} from news_classified
        where relevant = 1 group by day
    union all select 'payload', day, n_articles, n_risk from g_news
    union all select 'warehouse_articles', day, count(*), {big('sum(score)')} from news_classified group by day
    union all select 'warehouse_article_topic', day, count(*), {big('sum(topic_id)')} from {_TOPIC_LINKS} l group by day""")
def n1(t):
    version = Version.open(t.spark, _run(t))

    def figures(name, rows, n, m):
        return rows.groupBy("day").agg(F.lit(name).alias("name"), n.cast("long").alias("n"), m.cast("long").alias("m"))

    def table(name, schema, n, m):
        return figures(name, version.read(name, schema), n, m)

    rows, total = F.count("*"), F.sum("n_articles")
    dated = F.to_date("day").alias("day")
    payload = reports.read_payload(t.spark, *version.paths("payload"))
    metric = {n: F.sum(F.get_json_object("payload", f"$.metrics.{n}").cast("long")) for n in ("n_articles", "n_risk")}
    board = frames.parse_dashboard_csv(reports.read_dashboard_csv(t.spark, *version.paths("dashboard_csv")))
    parts = [
        table("articles", schemas.ARTICLES, rows, F.sum("relevant")),
        table("article_topic", daily.LINKED_TOPIC, rows, F.sum("topic_id")),
        table("daily_global", schemas.DAILY_GLOBAL, total, F.sum("n_sources")),
        table("daily_topic", schemas.DAILY_TOPIC, total, F.sum("n_risk")),
        table("daily_region", schemas.DAILY_REGION, total, F.sum("n_opportunity")),
        table("daily_source", schemas.DAILY_SOURCE, total, rows),
        figures("signals_csv", reports.read_signal_csv(t.spark, *version.paths("signals_csv")), rows, F.sum("score")),
        figures("dashboard_csv", board, rows, F.sum("risk")),
        figures("payload", payload, metric["n_articles"], metric["n_risk"]),
        figures("warehouse_articles", t.spark.read.parquet(*version.paths("warehouse_articles")).withColumn("day", dated),
                rows, F.sum("score")),
        figures("warehouse_article_topic", t.spark.read.parquet(*version.paths("warehouse_article_topic")),
                rows, F.sum("topic_id")),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("n2_backfill", f"""
    select day, source, count(*) as n_articles, {n_where('relevant = 1')} as n_relevant,
           {n_where('risk = 1')} as n_risk, {n_where('opportunity = 1')} as n_opportunity
    from series where day between date '2024-01-05' and date '2024-01-20' group by day, source""")
def n2(t):
    # stored rows of two runs, then one backfill over a range of days
    root = shared_dir(t.spark, "run")
    columns = {f.name: f.dataType for f in schemas.ARTICLES}
    rows = t("series").select(*[
        F.col(c).cast(k).alias(c) if c in t("series").columns else F.lit(None).cast(k).alias(c)
        for c, k in columns.items()])
    for run, part in (("first", "risk = 1"), ("second", "risk = 0")):
        version = Version.open(t.spark, root, run)
        version.put("articles", rows.filter(part), by_day=True)
        version.publish()
    made = daily.run_backfill(t.spark, root, "2024-01-05", "2024-01-20")
    return made["daily_source"]
