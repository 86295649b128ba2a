"""Aggregations (D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.dates import date_range
from ..operators import counts, frames, geo, ingest, quality, rollup, trends
from .frames_of import (
    export_frame, local_frame, news_classified, rollup_of, series_global,
)
from .q_relations import _BY_SOURCE, _BY_TITLE, SUBREGION
from .registry import query
from .sql import big, n_where, pct, sums, week
from .views import SERIES_AS_OF, STAR_AS_OF

_A, _B = "1996-01-01", "2000-12-31"
_RANGE = f"between date '{_A}' and date '{_B}'"
_LAST30 = f">= date '{STAR_AS_OF}' - 30"
_LAST365 = f">= date '{STAR_AS_OF}' - 365"
_FLAG_SUMS = "cast(sum(risk) as bigint) as risks, cast(sum(opportunity) as bigint) as opportunities"
_ROLL_SUMS = sums("n_articles", "n_risk", "n_opportunity")


@query("d1_days_with_data", "select distinct day from articles where day is not null")
def d1(t):
    return rollup.days_with_data(t("articles"))


@query("d2_conditional_count", f"select source, {n_where('risk = 1')} as n_risk from articles group by source")
def d2(t):
    return t("articles").groupBy("source").agg(rollup.count_where("risk").alias("n_risk"))


@query("d3_daily_global", "select * from g_star")
def d3(t):
    return rollup_of(t, "daily_global")


@query("d3_daily_global_news", "select * from g_news")
def d3b(t):
    return rollup.daily_global(news_classified(t).withColumn("deep_analysis", F.lit(0)))


@query("d4_daily_topic", "select * from t_star")
def d4(t):
    return rollup_of(t, "daily_topic")


@query("d5_daily_region", "select * from r_star")
def d5(t):
    return rollup_of(t, "daily_region")


@query("d6_daily_entity", "select * from e_star")
def d6(t):
    return rollup_of(t, "daily_entity")


@query("d7_daily_source", "select * from s_star")
def d7(t):
    return rollup_of(t, "daily_source")


_ALL_COLUMNS = {
    "daily_global": {"n_relevant": "n_relevant", "n_mixed": "n_mixed", "n_sources": "n_sources", "n_deep": "n_deep"},
    "daily_topic": {"id": "topic_id", "avg_score": "avg_score"},
    "daily_region": {"id": "region_id", "key": "geo_level"},
    "daily_entity": {"id": "entity_id", "n_articles": "mentions", "freq_total": "freq_total"},
    "daily_source": {"key": "source", "n_relevant": "n_relevant"},
}
_ALL_TYPES = {
    "id": "bigint", "key": "string", "n_articles": "bigint", "n_relevant": "bigint", "n_risk": "bigint",
    "n_opportunity": "bigint", "n_mixed": "bigint", "n_sources": "bigint", "n_deep": "bigint",
    "freq_total": "bigint", "avg_score": "double",
}


def _all_columns(name: str) -> str:
    """Select list that puts every column of a rollup into the common form."""
    own = {"n_articles": "n_articles", "n_risk": "n_risk", "n_opportunity": "n_opportunity"} | _ALL_COLUMNS[name]
    return f"'{name}' as name, day, " + ", ".join(
        f"cast({own.get(c, 'null')} as {kind}) as {c}" for c, kind in _ALL_TYPES.items())


@query("d8_rollup_all", " union all ".join(
    f"select {_all_columns(name)} from {rows} where day {_RANGE}"
    for name, rows in zip(rollup.ROLLUPS, ("g_star", "t_star", "r_star", "e_star", "s_star"), strict=True)))
def d8(t):
    days = date_range(t("articles"), _A, _B).select("day").distinct()
    made = rollup.rollup_all(t("articles"), t("article_topic"), t("article_entity"), days)
    return reduce(lambda x, y: x.union(y), [
        df.selectExpr(*_all_columns(name).split(", ")) for name, df in made.items()])


@query("d9_count_by_topic", f"""
    select name as topic, count(*) as total, {_FLAG_SUMS} from articles a
    join article_topic l on a.id = l.article_id join topics on topic_id = topics.id
    where day {_RANGE} group by name""")
def d9(t):
    return counts.count_by_topic(t("articles"), t("article_topic"), t("topics"), _A, _B)


@query("d10_top_entities", f"""
    select entity_id, name as entity, kind, count(*) as mentions, count(distinct article_id) as articles
    from article_entity join entities on entity_id = entities.id join articles a on article_id = a.id
    where kind = 'ORG' and day {_RANGE} group by entity_id, name, kind
    order by mentions desc, entity_id limit 20""")
def d10(t):
    return counts.top_entities(t("articles"), t("article_entity"), t("entities"), "ORG", 20, _A, _B)


# the entity of part 2, whatever its name is at this scale
_NAME = "(select name from entities where id = 2)"


def _name(t):
    return t("entities").filter("id = 2").select("name").scalar()


@query("d11_entity_timeline", f"""
    select day, count(*) as mentions from article_entity join entities on entity_id = entities.id
    join articles a on article_id = a.id
    where name = {_NAME} and day >= date '{STAR_AS_OF}' - 2400 group by day""")
def d11(t):
    return counts.entity_timeline(
        t("articles"), t("article_entity"), t("entities"), _name(t), STAR_AS_OF, 2400)


@query("d12_key_entities_at_risk", f"""
    select entity_id, name as entity, category, count(*) as risk_mentions
    from article_entity join entities on entity_id = entities.id join articles a on article_id = a.id
    where is_key = 1 and risk = 1 and day {_RANGE} group by entity_id, name, category""")
def d12(t):
    return counts.key_entities_at_risk(t("articles"), t("article_entity"), t("entities"), _A, _B)


@query("d13_count_by_region", f"""
    select r.id as region_id, r.name as region, r.kind as region_kind, count(*) as total, {_FLAG_SUMS}
    from articles a join regions r on a.region_id = r.id group by r.id, r.name, r.kind""")
def d13(t):
    return counts.count_by_region(t("articles"), t("regions"))


@query("d14_topic_region", """
    select topic_id, topics.name as topic, region_id, r.name as region, count(*) as total
    from articles a join article_topic l on a.id = l.article_id join topics on topic_id = topics.id
    join regions r on a.region_id = r.id group by topic_id, topics.name, region_id, r.name""")
def d14(t):
    return counts.topic_region_counts(t("articles"), t("article_topic"), t("topics"), t("regions"))


@query("d15_count_by_day", f"""
    select day, count(*) as total, {n_where('relevant = 1')} as relevant, {_FLAG_SUMS} from articles
    where day {_LAST30} group by day""")
def d15(t):
    return counts.count_by_day(t("articles"), STAR_AS_OF, 30)


@query("d16_count_by_source", f"""
    select source, count(*) as total, {n_where('relevant = 1')} as relevant, {_FLAG_SUMS} from articles
    where day {_RANGE} group by source""")
def d16(t):
    return counts.count_by_source(t("articles"), _A, _B)


@query("d17_period_summary", f"""
    select count(*) as n_articles, {n_where('relevant = 1')} as n_relevant,
      {big('sum(risk)')} as n_risk, {big('sum(opportunity)')} as n_opportunity,
      {n_where('risk = 1 and opportunity = 1')} as n_mixed, count(distinct source) as n_sources,
      {big('sum(deep_analysis)')} as n_deep from articles where day {_RANGE}""")
def d17(t):
    return counts.period_summary(t("articles"), _A, _B)


@query("d18_topic_series", f"""
    select day, name as topic, n_articles, n_risk, n_opportunity, avg_score
    from t_star join topics on topic_id = topics.id where topic_id = 3 and day {_LAST365}""")
def d18(t):
    return counts.topic_series(rollup_of(t, "daily_topic"), t("topics"), 3, STAR_AS_OF, 365)


@query("d19_entity_series", f"""
    select day, name as entity, kind, mentions, n_risk, n_opportunity, freq_total
    from e_star join entities on entity_id = entities.id where entity_id = 7 and day {_LAST365}""")
def d19(t):
    return counts.entity_series(rollup_of(t, "daily_entity"), t("entities"), 7, STAR_AS_OF, 365)


@query("d20_top_entities_of_period", f"""
    select entity_id, name as entity, kind, is_key, category, {sums('mentions', 'n_risk', 'n_opportunity')},
           count(distinct day) as active_days
    from e_star join entities on entity_id = entities.id where day {_LAST365} and kind = 'PER'
    group by entity_id, name, kind, is_key, category order by mentions desc, entity_id limit 20""")
def d20(t):
    return counts.top_entities_of_period(
        rollup_of(t, "daily_entity"), t("entities"), STAR_AS_OF, 365, 20, "PER")


@query("d21_top_mentioned", f"""
    select entity_id, name as entity, kind, {sums('mentions')}
    from e_star join entities on entity_id = entities.id where day {_LAST365}
    group by entity_id, name, kind order by mentions desc, entity_id limit 20""")
def d21(t):
    return counts.top_mentioned(rollup_of(t, "daily_entity"), t("entities"), STAR_AS_OF, 365)


@query("d21_entity_trends", f"""
    select entity_id, name as entity, kind, {sums('mentions', 'n_risk', 'n_opportunity')}
    from e_star join entities on entity_id = entities.id where day {_RANGE}
    group by entity_id, name, kind order by mentions desc, entity_id limit 20""")
def d21b(t):
    return counts.entity_trends(rollup_of(t, "daily_entity"), t("entities"), _A, _B)


@query("d22_entity_sparkline", f"""
    select day, {sums('mentions')} from e_star join entities on entity_id = entities.id
    where name = {_NAME} and day {_RANGE} group by day""")
def d22(t):
    return counts.entity_sparkline(rollup_of(t, "daily_entity"), t("entities"), _name(t), _A, _B)


@query("d23_topic_trends", f"""
    select day, topic_id, name as topic, n_articles, n_risk, n_opportunity, avg_score
    from t_star join topics on topic_id = topics.id where day {_RANGE}""")
def d23(t):
    return counts.topic_trends(rollup_of(t, "daily_topic"), t("topics"), _A, _B)


@query("d23_topic_trend_days", f"""
    select day, topic_id, name as topic, n_articles, n_risk, n_opportunity, avg_score
    from t_star join topics on topic_id = topics.id where day {_LAST30}""")
def d23b(t):
    return counts.topic_trends(rollup_of(t, "daily_topic"), t("topics"), as_of=STAR_AS_OF, days=30)


@query("d24_region_trends", f"""
    select day, region_id, geo_level, n_articles, n_risk, n_opportunity,
           case when region_id = -1 then 'Sin region' else coalesce(name, 'Sin region') end as region
    from r_star left join regions on region_id = regions.id and region_id <> -1
    where day {_LAST365}""")
def d24(t):
    return counts.region_trends(rollup_of(t, "daily_region"), t("regions"), STAR_AS_OF, 365)


_ALL = sums("n_articles", "n_relevant", "n_risk", "n_opportunity", "n_mixed")


@query("d25_weekly_totals", f"""
    select {week('day')} as week, {_ALL}, avg(n_sources) as avg_sources from g_star
    where day >= date '{STAR_AS_OF}' - 84 group by 1""")
def d25(t):
    return trends.weekly_totals(rollup_of(t, "daily_global"), STAR_AS_OF, 12)


@query("d25_weekly_totals_all", f"""
    select {week('day')} as week, {_ALL}, avg(n_sources) as avg_sources from g_star
    where day >= date '{STAR_AS_OF}' - 2800 group by 1""")
def d25b(t):
    return trends.weekly_totals(rollup_of(t, "daily_global"), STAR_AS_OF, 400)


@query("d26_monthly_totals", f"""
    select strftime(day, '%Y-%m') as month, {_ALL}, avg(n_sources) as avg_sources,
           count(*) as days_with_data from g_star
    where day >= date '{STAR_AS_OF}' - 372 group by 1""")
def d26(t):
    return trends.monthly_totals(rollup_of(t, "daily_global"), STAR_AS_OF, 12)


@query("d27_weekly_topics", f"""
    select {week('day')} as week, name as topic, {_ROLL_SUMS}
    from t_star join topics on topic_id = topics.id
    where day >= date '{STAR_AS_OF}' - 84 group by 1, 2""")
def d27(t):
    return trends.weekly_topics(rollup_of(t, "daily_topic"), t("topics"), STAR_AS_OF, 12)


def _compare(source: str, a: str, b: str, c: str, d: str) -> str:
    ms = ["n_articles", "n_relevant", "n_risk", "n_opportunity"]
    cols = [
        f"cast(coalesce(sum({m}) filter (day between {lo} and {hi}), 0) as bigint) as {p}_{m}"
        for p, lo, hi in (("cur", a, b), ("prev", c, d)) for m in ms
    ]
    changes = [f"{pct(f'cur_{m}', f'prev_{m}')} as pct_{m}" for m in ms]
    return f"select *, {', '.join(changes)} from (select {', '.join(cols)} from {source}) p"


@query("d28_compare_periods", _compare(
    "g_star", "date '2000-01-01'", "date '2000-12-31'", "date '1999-01-01'", "date '1999-12-31'"))
def d28(t):
    return trends.compare_periods(
        rollup_of(t, "daily_global"), ("2000-01-01", "2000-12-31"), ("1999-01-01", "1999-12-31"))


_S = f"date '{SERIES_AS_OF}'"


@query("d29_compare_with_previous", _compare("g_series", f"{_S} - 6", _S, f"{_S} - 13", f"{_S} - 7"))
def d29(t):
    return trends.compare_with_previous(series_global(t), SERIES_AS_OF, 7)


@query("d30_day_over_day", f"""
    select a.day, {pct('a.n_articles', 'b.n_articles')} as pct_n_articles,
           {pct('a.n_risk', 'b.n_risk')} as pct_n_risk,
           {pct('a.n_opportunity', 'b.n_opportunity')} as pct_n_opportunity
    from g_series a join g_series b on a.day = b.day + 1""")
def d30(t):
    return trends.day_over_day(series_global(t))


def _in(metric: str, start: str, end: str, name: str) -> str:
    return big(f"coalesce(sum({metric}) filter (day between {start} and {end}), 0)") + f" as {name}"


_KPI_SUMS = ", ".join(
    [_in(m, "date '2024-01-05'", "date '2024-01-25'", m)
     for m in ("n_articles", "n_relevant", "n_risk", "n_opportunity", "n_deep")]
    + [_in(m, f"{_S} - 7", _S, f"cur_{m}") for m in ("n_articles", "n_risk", "n_opportunity")]
    + [_in(m, f"{_S} - 14", f"{_S} - 8", f"prev_{m}") for m in ("n_articles", "n_risk", "n_opportunity")]
)
_KPI_DELTAS = ", ".join(
    f"cast({pct(f'cur_{m}', f'prev_{m}', 0)} as bigint) as delta_{m}"
    for m in ("n_articles", "n_risk", "n_opportunity")
)


@query("d31_kpis", f"""
    select n_articles, n_relevant, n_risk, n_opportunity, n_deep, {_KPI_DELTAS}
    from (select {_KPI_SUMS} from g_series) k""")
def d31(t):
    return trends.kpis(series_global(t), "2024-01-05", "2024-01-25", SERIES_AS_OF)


def _floored(m: str) -> str:
    return (f"case when pn > 0 then cast(round_even((c_{m} - p_{m}) / greatest(p_{m}, 1) * 100, 0) "
            f"as bigint) end as delta_n_{m}")


@query("d32_kpis_from_articles", f"""
    select n_articles, n_risk, n_opportunity, n_deep,
      cast({pct('cn', 'pn', 0)} as bigint) as delta_n_articles,
      {_floored('risk')}, {_floored('opportunity')} from (
        select count(*) as n_articles, {n_where('risk = 1')} as n_risk,
          {n_where('opportunity = 1')} as n_opportunity, {big('coalesce(sum(deep_analysis), 0)')} as n_deep,
          {n_where(f'day between {_S} - 7 and {_S}')} as cn,
          {n_where(f'day >= {_S} - 14 and day < {_S} - 7')} as pn,
          {n_where(f'risk = 1 and day between {_S} - 7 and {_S}')} as c_risk,
          {n_where(f'risk = 1 and day >= {_S} - 14 and day < {_S} - 7')} as p_risk,
          {n_where(f'opportunity = 1 and day between {_S} - 7 and {_S}')} as c_opportunity,
          {n_where(f'opportunity = 1 and day >= {_S} - 14 and day < {_S} - 7')} as p_opportunity
        from series) k""")
def d32(t):
    return trends.kpis_from_articles(t("series"), SERIES_AS_OF)


@query("d33_topic_text", """
    select article_id, string_agg(name, '|' order by name) as topics
    from article_topic join topics on topic_id = topics.id group by article_id""")
def d33(t):
    named = counts.topic_names(t("article_topic"), t("topics")).withColumnRenamed("topic", "name")
    return named.groupBy("article_id").agg(counts.topic_text().alias("topics"))


@query("d34_system_health", "select count(*) as n_articles, max(day) as last_day from articles")
def d34(t):
    return counts.system_health(t("articles"))


@query("d35_source_volume", f"""
    select source, {sums('n_articles', 'n_relevant', 'n_risk', 'n_opportunity')} from s_star
    where day {_RANGE} group by source order by n_articles desc, source limit 20""")
def d35(t):
    return counts.source_volume(rollup_of(t, "daily_source"), _A, _B, 20)


_LEVELS = f"""select geo_level, count(*) as n_articles, {big('sum(risk)')} as n_risk,
    {big('sum(opportunity)')} as n_opportunity from articles where day {_RANGE}"""


@query("d36_level_distribution", f"{_LEVELS} group by geo_level")
def d36(t):
    return counts.level_distribution(t("articles"), _A, _B)


@query("d36_one_level", f"{_LEVELS} and geo_level = 'nacional' group by geo_level")
def d36b(t):
    return counts.level_distribution(t("articles"), _A, _B, "nacional")


@query("d36_level_frame", f"""
    select geo_level, count(*) as total, {_FLAG_SUMS} from export_rows group by geo_level""")
def d36c(t):
    return frames.volume_by_level(export_frame(t))


@query("d37_municipality_counts", f"""
    select subregion, municipality, count(*) as total, {n_where('risk > 0')} as risks,
           {n_where('opportunity > 0')} as opportunities from (
        select n.*, coalesce(s.municipality, h.municipality) as municipality,
               coalesce(s.subregion, h.subregion) as subregion
        from local_news n left join ({_BY_SOURCE}) s on n.source = s.source
        left join ({_BY_TITLE}) h on n.id = h.id) a
    where subregion is not null group by subregion, municipality""")
def d37(t):
    placed = geo.attributed_articles(t("local_news"), t("municipalities"), title_names=None)
    return placed.groupBy("subregion", "municipality").agg(
        F.count("*").alias("total"), F.count_if(F.col("risk") > 0).alias("risks"),
        F.count_if(F.col("opportunity") > 0).alias("opportunities"),
    ).orderBy("subregion", F.desc("total"))


@query("d38_topic_totals", f"""
    select name as topic, {_ROLL_SUMS} from t_star join topics on topic_id = topics.id
    where day {_RANGE} group by name""")
def d38(t):
    return counts.topic_totals(rollup_of(t, "daily_topic"), t("topics"), _A, _B)


@query("d39_kind_counts", "select kind, count(*) as n from export_kinds group by kind")
def d39(t):
    return frames.kind_counts(export_frame(t))


@query("d40_volume_by_day", f"""
    select day, count(*) as total, {_FLAG_SUMS} from export_rows where day {_LAST365} group by day""")
def d40(t):
    return frames.volume_by_day(export_frame(t), STAR_AS_OF, 365)


_TOPICS = ["inversion", "industria", "energia", "aranceles", "tema_nuevo"]


@query("d41_topic_day_pivot", f"""
    select day, {', '.join(f"{n_where(f"topic = '{x}'")} as {x}" for x in _TOPICS)}
    from export_topics where day {_LAST365} group by day""")
def d41(t):
    return frames.topic_day_pivot(export_frame(t), _TOPICS, STAR_AS_OF, 365)


@query("d42_volume_by_source", f"""
    select source, count(*) as total, {_FLAG_SUMS} from export_rows where day {_LAST365} group by source""")
def d42(t):
    return frames.volume_by_source(export_frame(t), STAR_AS_OF, 365)


@query("d43_name_counts", f"""
    select trim(name) as entity, count(*) as mentions, {n_where('risk = 1')} as risks,
           {n_where('opportunity = 1')} as opportunities from (
        select risk, opportunity, unnest(string_split(persons_text || ',' || orgs_text, ',')) as name
        from export_rows where day {_LAST365}) n
    where trim(name) <> '' group by 1 order by mentions desc, entity limit 20""")
def d43(t):
    return frames.name_counts(export_frame(t), STAR_AS_OF, 365)


@query("d44_place_counts", """
    select trim(name) as place, count(*) as mentions from (
        select unnest(string_split(places_text, ',')) as name from export_rows) n
    where trim(name) <> '' group by 1 order by mentions desc, place limit 20""")
def d44(t):
    return frames.place_counts(export_frame(t))


_WEEK = "from export_rows, last_day where day between d - 6 and d"


@query("d45_weekly_kpis", f"""
    select count(*) as n_articles, {big('coalesce(sum(risk), 0)')} as n_risk,
      {big('coalesce(sum(opportunity), 0)')} as n_opportunity, count(distinct source) as n_sources {_WEEK}""")
def d45(t):
    return frames.weekly_kpis(frames.week_rows(export_frame(t)))


_LABEL = """case topic when 'inversion' then 'Inversión' when 'industria' then 'Industria'
    when 'energia' then 'Energía' when 'aranceles' then 'Aranceles' else 'Tema Nuevo' end"""


@query("d46_topic_shares", f"""
    select topic, {_LABEL} as label, count(*) as n, count(*) / (select count(*) {_WEEK}) as share
    from export_topics, last_day where day between d - 6 and d
    group by topic order by n desc, topic limit 8""")
def d46(t):
    return frames.topic_shares(frames.week_rows(export_frame(t)))


@query("d47_subregion_stats", f"""
    select o.subregion, cast(o.ord as int) as ord, {big('coalesce(n, 0)')} as n,
           {big('coalesce(risks, 0)')} as risks, {big('coalesce(opportunities, 0)')} as opportunities
    from (select subregion, min(ord) as ord from municipalities group by 1) o left join (
        select subregion, count(*) as n, sum(risk) as risks, sum(opportunity) as opportunities
        from ({SUBREGION}) s join local_news l on s.id = l.id group by subregion) c
    on o.subregion = c.subregion""")
def d47(t):
    return frames.subregion_stats(local_frame(t), t("municipalities"))


@query("d48_conclusions", f"""
    select count(*) as n_articles, {big('coalesce(sum(risk), 0)')} as n_risk,
      {big('coalesce(sum(opportunity), 0)')} as n_opportunity,
      (select topic from export_topics, last_day where day between d - 6 and d
       group by topic order by count(*) desc, topic limit 1) as top_topic,
      (select count(*) as c from export_topics, last_day where day between d - 6 and d
       group by topic order by c desc, topic limit 1) as top_count {_WEEK}""")
def d48(t):
    return frames.conclusions(frames.week_rows(export_frame(t)))


@query("d49_anomalies", f"""
    select day, s.metric, value, round_even(mean, 1) as mean, round_even(sd, 1) as deviation,
      case when value > mean + 1.5 * sd then 'alto' else 'bajo' end as direction,
      round_even((value - mean) / sd, 2) as z
    from (unpivot (select day, n_articles, n_risk, n_opportunity from g_series)
          on n_articles, n_risk, n_opportunity into name metric value value) u
    join (select metric, avg(value) as mean, stddev_samp(value) as sd
          from (unpivot (select day, n_articles, n_risk, n_opportunity from g_series)
                on n_articles, n_risk, n_opportunity into name metric value value) v
          group by metric) s on u.metric = s.metric
    where sd > 0 and (value > mean + 1.5 * sd or value < mean - 1.5 * sd)""")
def d49(t):
    return trends.anomalies(series_global(t), SERIES_AS_OF, 30, 1.5)


_FEED_AS_OF = "timestamp '2024-01-16 00:00:00'"
PROFILE = f"""
    select f.feed, coalesce(n, 0) as n_entries, case when n > 0 then 'ok' else 'empty' end as status,
      case when titles >= size * 0.8 then 1 else 0 end as has_titles,
      case when dates >= size * 0.5 then 1 else 0 end as has_dates,
      case when descriptions >= size * 0.5 then 1 else 0 end as has_descriptions,
      coalesce(recent, 0) as n_recent
    from feeds f left join (select feed, count(*) as n from feed_entries group by feed) c on f.feed = c.feed
    left join (select feed, count(*) as size, count(*) filter (trim(title) <> '') as titles,
                 count(*) filter (dated = 1) as dates, count(*) filter (trim(description) <> '') as descriptions,
                 count(*) filter (published > {_FEED_AS_OF} - interval 7 day) as recent
               from (select *, row_number() over (partition by feed order by pos) as rank
                     from feed_entries) r where rank <= 20 group by feed) p on f.feed = p.feed"""
_WARN = """array_to_string(list_filter([
    case when status <> 'ok' then 'No entries found' end,
    case when status = 'ok' and has_titles = 0 then 'Missing titles in >20% entries' end,
    case when status = 'ok' and has_dates = 0 then 'Missing dates in >50% entries' end,
    case when status = 'ok' and n_recent = 0 then 'No entries from last 7 days' end],
    lambda x: x is not null), '; ')"""


def _profile(t):
    return quality.feed_profile(
        t("feed_entries"), t("feeds"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query("d50_feed_profile", f"""
    select feed, n_entries, status, cast(has_titles as int) as has_titles,
      cast(has_dates as int) as has_dates, cast(has_descriptions as int) as has_descriptions,
      n_recent, {_WARN} as warnings from ({PROFILE}) p""")
def d50(t):
    return _profile(t).withColumn("warnings", F.array_join("warnings", "; ")).drop("sample_titles")


@query("d51_feed_scores", f"""
    select feed, case when status = 'ok' then cast(has_titles + has_dates + has_descriptions
        + case when n_recent > 0 then 1 else 0 end as int) end as score,
      case when status <> 'ok' then 'failed' when warnings = '' then 'ok' else 'warning' end as verdict
    from (select *, {_WARN} as warnings from ({PROFILE}) p) q""")
def d51(t):
    return quality.feed_scores(_profile(t))


@query("d51_feed_summary", f"""
    select {n_where("status = 'ok' and warnings = ''")} as n_ok,
      {n_where("status = 'ok' and warnings <> ''")} as n_warning,
      {n_where("status <> 'ok'")} as n_failed
    from (select *, {_WARN} as warnings from ({PROFILE}) p) q""")
def d51b(t):
    return quality.feed_summary(quality.feed_scores(_profile(t)))


_D = "date '1999-06-15'"


@query("d52_top_topics_of_day", f"""
    select name as topic, n_articles, n_risk, n_opportunity from t_star
    join topics on topic_id = topics.id where day = {_D} order by n_articles desc, topic_id limit 3""")
def d52(t):
    return counts.top_topics_of_day(rollup_of(t, "daily_topic"), t("topics"), "1999-06-15")


@query("d52_top_regions_of_day", f"""
    select case when region_id = -1 then geo_level else coalesce(name, geo_level) end as region,
      geo_level, n_articles, n_risk from r_star
    left join regions on region_id = regions.id and region_id <> -1
    where day = {_D} order by n_articles desc, region_id, geo_level limit 3""")
def d52b(t):
    return counts.top_regions_of_day(rollup_of(t, "daily_region"), t("regions"), "1999-06-15")


@query("d52_top_entities_of_day", f"""
    select name as entity, kind, mentions, n_risk from e_star
    join entities on entity_id = entities.id where day = {_D} order by mentions desc, entity_id limit 5""")
def d52c(t):
    return counts.top_entities_of_day(rollup_of(t, "daily_entity"), t("entities"), "1999-06-15")


_STATUS = """select doc_id as id, source, date '2024-01-01' + cast(doc_id % 60 as int) as day,
    l.quality as topics_done, l.toxic as entities_done,
    case when l.doc_id is null then 0 else 1 end as signals_done
    from documents d left join labels l using (doc_id)"""


def _status(t):
    both = t("documents").join(t("labels"), "doc_id", "left")
    rows = both.select(
        F.col("doc_id").alias("id"), "source",
        F.when(F.col("quality") == 1, F.array("lang")).alias("topics"),
        F.when(F.col("toxic") == 1, F.array("lang")).alias("persons"),
        F.when(F.col("quality").isNotNull(), 1).alias("relevant"),
    )
    days = t("news").select("id", "day")
    return ingest.stage_status(rows.join(days, "id"))


@query("d53_completeness", f"""
    select count(*) as n_articles, {', '.join(f"{n_where(f'{s}_done = 1')} as {s}_done" for s in
      ('topics', 'entities', 'signals'))}, {', '.join(
      f"{n_where(f'coalesce({s}_done, 0) = 0')} as {s}_pending" for s in ('topics', 'entities', 'signals'))}
    from ({_STATUS}) s""")
def d53(t):
    return quality.completeness(_status(t))


@query("d54_rollup_gaps", """
    select day, raw_count, coalesce(n, 0) as rollup_count, raw_count - coalesce(n, 0) as difference
    from (select day, count(*) as raw_count from articles group by day) a left join (
        select day, count(*) as n from articles where relevant = 1 group by day) b using (day)""")
def d54(t):
    # against a rollup that is missing the rows classified last
    stale = rollup.daily_global(t("articles").filter("relevant = 1"))
    return quality.rollup_gaps(t("articles"), stale)


@query("d55_entity_kinds", "select kind, count(*) as n from entities group by kind")
def d55(t):
    return quality.entity_kinds(t("entities"))


@query("d56_daily_health", f"""
    select day, n_articles, n_unprocessed,
      case when n_articles < 10 then 'critical' when n_articles < 50 then 'warning' else 'ok' end
        as volume_health,
      case when n_unprocessed > 100 then 'critical' when n_unprocessed > 10 then 'warning' else 'ok' end
        as backlog_health
    from (select day, count(*) as n_articles,
            {n_where('coalesce(topics_done, 0) * coalesce(entities_done, 0) = 0')} as n_unprocessed
          from ({_STATUS}) s group by day) h""")
def d56(t):
    return quality.daily_health(_status(t))
