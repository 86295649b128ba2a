"""SQL fragments of the checks (DuckDB dialect)."""

from __future__ import annotations

from .registry import SHARED
from .views import NEWS_OPPORTUNITY, NEWS_RISK, NEWS_TOPICS


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def norm(x: str) -> str:
    return rf"regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def week(d: str) -> str:
    return f"strftime({d}, '%Y-W%W')"


def pct(cur: str, prev: str, digits: int = 1) -> str:
    return f"case when {prev} > 0 then round_even(({cur} - {prev}) / {prev} * 100, {digits}) end"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def n_where(cond: str) -> str:
    return big(f"count(*) filter ({cond})")


def kind(r: str = "risk", o: str = "opportunity") -> str:
    return (
        f"case when {r} = 1 and {o} = 1 then 'MIXTO' when {r} = 1 then 'RIESGO' "
        f"when {o} = 1 then 'OPORTUNIDAD' else 'NEUTRO' end"
    )


def sums(*cols: str) -> str:
    return ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in cols)


def topic_list(t: str) -> str:
    cases = ", ".join(
        f"case when {any_of(t, terms)} then '{name}' end" for name, terms in NEWS_TOPICS.items()
    )
    return f"list_filter([{cases}], lambda x: x is not null)"


_counts = (
    f"{n_where('risk = 1')} as n_risk, {n_where('opportunity = 1')} as n_opportunity"
)


def global_rollup(rows: str, extra: str = "") -> str:
    return f"""select day, count(*) as n_articles, {n_where('relevant = 1')} as n_relevant, {_counts},
        {n_where('risk = 1 and opportunity = 1')} as n_mixed,
        count(distinct source) as n_sources, {n_where('deep_analysis = 1')} as n_deep
        from {rows} {extra} group by day"""


SHARED.update(
    {
        "news_unique": """select * from (
            select *, row_number() over (partition by url order by id) as rn from news) u
            where rn = 1""",
        "news_scored": f"""select *, {topic_list('t')} as found,
            {any_of('s', NEWS_RISK)} as is_risk, {any_of('s', NEWS_OPPORTUNITY)} as is_opp
            from (select *,
                {norm("case when trim(description) = '' then title else description end")} as t,
                {fold("title || ' ' || coalesce(description, '')")} as s from news_unique) x""",
        "news_classified": """select id, title, description, url, source, day,
            array_to_string(found, ',') as topics, cast(len(found) as int) as score,
            case when len(found) > 0 then 1 else 0 end as relevant,
            case when len(found) > 0 and is_risk then 1 else 0 end as risk,
            case when len(found) > 0 and is_opp then 1 else 0 end as opportunity,
            0 as deep_analysis from news_scored""",
        "g_star": global_rollup("articles"),
        "g_series": global_rollup("series"),
        "g_news": global_rollup("news_classified"),
        "t_star": f"""select day, topic_id, count(*) as n_articles, {_counts}, avg(t.score) as avg_score
            from articles a join article_topic t on a.id = t.article_id group by day, topic_id""",
        "r_star": f"""select day, coalesce(region_id, -1) as region_id,
            coalesce(geo_level, 'indeterminado') as geo_level, count(*) as n_articles, {_counts}
            from articles where relevant = 1 group by 1, 2, 3""",
        "e_star": f"""select day, entity_id, count(*) as mentions, {_counts},
            cast(sum(freq) as bigint) as freq_total
            from articles a join article_entity e on a.id = e.article_id group by day, entity_id""",
        "s_star": f"""select day, source, count(*) as n_articles,
            {n_where('relevant = 1')} as n_relevant, {_counts}
            from articles where source is not null group by day, source""",
        "export_kinds": f"select *, {kind()} as kind from export_rows",
        "export_topics": """select * from (
            select id, day, title, source, risk, opportunity,
                   trim(unnest(string_split(topics_text, '|'))) as topic from export_rows) x
            where topic <> ''""",
        "last_day": "select max(day) as d from export_rows",
    }
)
