"""Views that give the supplied test tables the shape of the engine's tables.

One SQL text per view, understood by both dialects, so that a query and its check start
from the same rows. Nothing is filtered here: every view covers its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, tune

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# tables whose queries spend their time on long texts
TEXT_TABLES = ("documents", "pages")

# inside the data, so that later days count where a range is open
STAR_AS_OF = "2001-03-01"
SERIES_AS_OF = "2024-01-30"
NEWS_AS_OF = "2024-02-29"

# dictionary for the invented prose of `documents`
NEWS_TOPICS = {
    "t_ment": ["eau", "ment"],
    "t_sch": ["sch", "von"],
    "t_cion": ["cion", "para"],
    "t_hein": ["hein", "ouen"],
}
NEWS_RISK = ["worthless", "token", "licen", "sch"]
NEWS_OPPORTUNITY = ["ouen", "ment"]

VIEWS: dict[str, str] = {
    # documents as articles: first line = headline, whole text = description
    "news": """
        select doc_id as id, trim(split_part(text, chr(10), 1)) as title, text as description,
               'doc://' || md5(text) as url, source,
               date '2024-01-01' + cast(doc_id % 60 as int) as day
        from documents""",
    # orders as classified articles
    "articles": """
        select o_orderkey as id,
               c_mktsegment || ' order for ' || n_name || ' at priority ' || o_orderpriority as title,
               '' as description, 'order://' || cast(o_orderkey as string) as url,
               cast(o_orderdate as date) as day, c_mktsegment || ' ' || n_name as source,
               cast(substr(o_orderpriority, 1, 1) as int) as score,
               case when o_orderstatus <> 'P' then 1 else 0 end as relevant,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as risk,
               case when o_totalprice >= 300000 then 1 else 0 end as opportunity,
               case when o_totalprice > 400000 then 1 else 0 end as deep_analysis,
               cast(nullif(c_nationkey, 0) as bigint) as region_id,
               case r_name when 'AMERICA' then 'estatal' when 'ASIA' then 'nacional'
                           when 'EUROPE' then 'internacional' when 'AFRICA' then 'indeterminado'
               end as geo_level
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey""",
    "parts": """
        select p_partkey, p_name, p_type, p_brand, p_size,
               cast(case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3
                                when 'PROMO' then 4 when 'SMALL' then 5 else 6 end as bigint) as topic_id,
               case when p_type in ('ECONOMY', 'SMALL') then 'ORG'
                    when p_type in ('STANDARD', 'MEDIUM') then 'PER'
                    when p_type = 'LARGE' then 'LOC' else 'MISC' end as kind
        from part""",
    "topics": """
        select distinct topic_id as id, p_type as name,
               case when p_type <> 'PROMO' then 1 else 0 end as active from parts""",
    "article_topic": """
        select l_orderkey as article_id, topic_id, count(*) as score
        from lineitem join parts on l_partkey = p_partkey group by l_orderkey, topic_id""",
    "article_entity": """
        select l_orderkey as article_id, l_partkey as entity_id, 'mencionado' as role,
               count(*) as freq
        from lineitem group by l_orderkey, l_partkey""",
    "entities": """
        select p_partkey as id, p_name || ' #' || cast(p_partkey as string) as name, kind,
               case when p_size <= 5 then 1 else 0 end as is_key, p_brand as category
        from parts""",
    "regions": """
        select cast(n_nationkey as bigint) as id, n_name as name, lower(n_name) as name_norm,
               r_name as kind
        from nation join region on n_regionkey = r_regionkey""",
    # events as dated signals
    "series": """
        select event_id as id, ts, cast(ts as date) as day, event_type as source, props as title,
               case when event_type <> 'view' then 1 else 0 end as relevant,
               case when event_type = 'error' then 1 else 0 end as risk,
               case when event_type in ('purchase', 'signup') or value > 100 then 1 else 0 end
                   as opportunity,
               case when value > 150 then 1 else 0 end as deep_analysis
        from events""",
    # events as the entries of per-user feeds, in feed order by event_id
    "feed_entries": """
        select 'feed-' || cast(user_id as string) as feed, event_id as pos, ts,
               case when event_type = 'view' then '  ' else event_type || ' ' || props end as title,
               case when value > 35 then props else '' end as description,
               case when event_type in ('purchase', 'error', 'signup') then 1 else 0 end as dated,
               case when event_type in ('purchase', 'error', 'signup') then ts end as published
        from events""",
    "feeds": """
        select distinct feed from (
            select 'feed-' || cast(user_id as string) as feed from events
            union all select 'feed-' || cast(c_custkey as string) as feed from customer) f""",
    # documents as raw feed entries with blanks, duplicates and odd dates
    "raw_entries": """
        select source, doc_id as seq, '  ' || split_part(text, chr(10), 1) || ' ' as title,
               case when n_chars < 100 then ' ' else 'doc://' || md5(text) || ' ' end as link,
               case when lang = 'en' then '' else text end as summary, text as description,
               case lang when 'fr' then 'Tue, 20 Feb 2024 14:00:00 -0600'
                         when 'de' then '5 Mar 2024 09:15:00 +0100'
                         when 'es' then '2024-01-15T10:30:00Z' end as published
        from documents""",
    "municipalities": """
        select cast(n_nationkey as int) as ord, n_name as municipality, r_name as subregion
        from nation join region on n_regionkey = r_regionkey""",
    # orders as local news: municipality in the feed name, half of it, or in the headline
    "local_news": """
        select o_orderkey as id, cast(o_orderdate as date) as day,
               case c_mktsegment
                    when 'BUILDING' then 'Google News - ' || n_name || ' Coahuila'
                    when 'MACHINERY' then 'Google News - ' || lower(n_name) || ' centro'
                    else 'Daily ' || c_mktsegment end as source,
               case when c_mktsegment = 'FURNITURE' then 'Mina de carbon, ' || o_orderpriority
                    else c_mktsegment || ' order for ' || n_name end as title,
               case when o_orderpriority = '5-LOW' then n_name else r_name end as places_text,
               case r_name when 'AMERICA' then 'Estatal' when 'ASIA' then 'nacional'
                    else 'internacional' end as geo_level,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as risk,
               case when o_totalprice >= 300000 then 1 else 0 end as opportunity
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey""",
    # orders as exported dashboard rows with text lists
    "export_rows": """
        select o_orderkey as id, cast(o_orderdate as date) as day,
               c_mktsegment || ' ' || n_name as source,
               c_mktsegment || ' order for ' || n_name || ' at priority ' || o_orderpriority
                   || ' handled for ' || c_name || '; value class '
                   || case when o_totalprice >= 300000 then 'large, with a follow-up visit planned'
                           else 'small' end as title,
               case when o_orderstatus = 'P' then '' else 'order://' || cast(o_orderkey as string)
                   end as url,
               c_name as persons_text, c_mktsegment || ' Inc, ' || n_name || ' Corp' as orgs_text,
               n_name || ', ' || r_name || ',' as places_text,
               case c_mktsegment when 'BUILDING' then 'inversion' when 'MACHINERY' then 'industria'
                    when 'AUTOMOBILE' then 'energia' when 'FURNITURE' then 'tema_nuevo' else '' end
                   || case when o_orderpriority = '1-URGENT' then '|aranceles' else '' end
                   as topics_text,
               case r_name when 'AMERICA' then 'estatal' when 'ASIA' then 'nacional'
                           when 'EUROPE' then 'internacional' else 'indeterminado' end as geo_level,
               case when o_totalprice > 400000 then 1 else 0 end as deep_analysis,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end as risk,
               case when o_totalprice >= 300000 then 1 else 0 end as opportunity
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey""",
    # line items as mentions of part names, in two spellings
    "name_mentions": """
        select l_orderkey as article_id, l_linenumber as pos,
               case when l_returnflag = 'R' then upper(p_name) else p_name end as surface, kind
        from lineitem join parts on l_partkey = p_partkey""",
    "known_aliases": """
        select min(p_partkey) as entity_id, p_name as alias from part
        where p_brand in ('Brand#1', 'Brand#2') group by p_name""",
    "known_entities": """
        select 1000000000 + min(p_partkey) as id, upper(p_name) as name, 'ORG' as kind,
               0 as is_key, 'known' as category
        from part where p_brand in ('Brand#3', 'Brand#4', 'Brand#5') group by upper(p_name)""",
    # part names and types as a keyword table
    "keyword_rows": """
        select 'topic' as kind, p_type as grp, p_name as term, cast(p_partkey as int) as ord
        from part""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def names_in(sql: str, known: set[str]) -> list[str]:
    return [n for n in dict.fromkeys(_WORD.findall(sql)) if n in known]


class Tables:
    """Base tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._made[name] = spread(table) if name in TEXT_TABLES else table
            else:
                self._made[name] = self.sql(VIEWS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views named in it."""
        used = names_in(text, set(BASE) | set(VIEWS))
        # names after FROM or JOIN are tables
        marked = re.sub(
            r"(?i)\b(from|join)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", text
        )
        return self.spark.sql(marked, **{n: self(n) for n in used if "{" + n + "}" in marked})


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Check SQL with the views (and ``extra`` named queries) it uses as leading CTEs."""
    pool = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def add(text: str, owner: str | None) -> None:
        for name in names_in(text, set(pool)):
            if name != owner and name not in order:
                add(pool[name], name)
                order.append(name)

    add(sql, None)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({pool[n].strip()})" for n in order)
    return f"with {ctes}\n{sql.strip()}"
