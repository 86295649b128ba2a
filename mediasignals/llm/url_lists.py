"""URL filters by a temporal join with dated list entries.

An entry adds a value to a list, or removes it, at a date. The values are domains (they hold
for every host below), paths (a host and the beginning of a path, up to a slash or to any other
character) or urls (a host and a whole path: one page, with any query). Hosts are compared
without case, paths with it. The entries of a value become validity intervals, from an addition to the next entry, and a
capture is matched with the intervals that hold at its fetch date: an as-of join.

A capture asks for each suffix of its host, for its page, and for each beginning of its path that
ends in a slash or is as long as some entry that does not. Questions and
intervals meet by value and by period of ``PERIOD`` days, so that a value asked for by a third of
all captures is spread over the periods, and adaptive execution splits what is still large.
Intervals are cut to the dates of the captures.

Defined results: a null or relative url, and a null date, match nothing; an empty path is a slash
for urls and for entries that end in one; a path entry without a slash holds for its host; entries with nulls
are left out; of entries of a value on one date, a removal comes last; an interval does not
hold on its last day; repeated captures are judged each by itself; input columns with the
names of result columns are replaced. Urls are used whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

PERIOD = 32
ALLOW = "allow"
_ID = "_capture"


def host(url: Column) -> Column:
    """Lower-cased, without user, port and a dot at the end; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.coalesce(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def questions(url: Column, lengths: Sequence[int] = ()) -> Column:
    """Every value that an entry matching the url can have, as structs of kind and value;
    ``lengths`` are those of the path entries that do not end in a slash."""
    name = host(url)
    labels, parts = F.split(name, r"\."), F.split(path(url), "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    paths = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.struct(
            F.lit("path").alias("kind"), F.concat(name, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")).alias("value")
        ),
    )
    page = F.struct(F.lit("url").alias("kind"), F.concat(name, F.when(path(url) == "", "/").otherwise(path(url))).alias("value"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    asked = [domains, paths, F.array(page)]
    if lengths:
        full = F.concat(name, path(url))
        fitting = F.filter(F.lit(list(lengths)), lambda n: (n >= F.length(name)) & (n <= F.length(full)))
        begun = F.transform(
            fitting, lambda n: F.struct(F.lit("path").alias("kind"), F.substring(full, F.lit(1), n).alias("value"))
        )
        asked.append(F.filter(begun, lambda q: ~F.endswith(q["value"], F.lit("/"))))
    return F.when(F.length(name) > 0, F.concat(*asked)).otherwise(none)


def normal(kind: Column, value: Column) -> Column:
    """The value of an entry with its host lower-cased; a path keeps its case."""
    at = F.instr(value, "/")
    cased = F.concat(F.lower(F.substring(value, F.lit(1), at)), F.substring(value, at + 1, F.length(value)))
    return (
        F.when((kind == "domain") | (at == 0), F.concat(F.lower(value), F.when(kind == "url", "/").otherwise("")))
        .otherwise(cased)
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) from entries (list, kind, value, day, action)."""
    names = ["list", "kind", "value", "day", "action"]
    clean = entries.select(*names).dropna().withColumn("value", normal(F.col("kind"), F.col("value"))).distinct()
    order = Window.partitionBy("list", "kind", "value").orderBy("day", "action")  # add before remove
    return (
        clean.withColumn("until", F.lead("day").over(order))
        .where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("day"))))
        .select("list", "kind", "value", F.col("day").alias("since"), "until")
    )


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """All columns of ``captures`` with ``matches`` (sorted ``list:value`` of the entries that
    hold at the fetch date) and ``blocked`` (some list but the allow list holds, and that one
    does not)."""
    captures = written(
        captures.drop("matches", "blocked", _ID).withColumn(_ID, F.monotonically_increasing_id()), "captures"
    )
    first, last = captures.agg(F.min(day), F.max(day)).first()
    held = intervals(entries).where((F.col("since") <= F.lit(last)) & (F.coalesce("until", F.date_add(F.lit(last), 1)) > F.lit(first)))
    short = held.where((F.col("kind") == "path") & ~F.endswith("value", F.lit("/")))
    # at most as many as the longest entry has characters
    lengths = sorted(r.n for r in short.select(F.length("value").alias("n")).distinct().collect())
    ends = F.date_sub(F.coalesce("until", F.date_add(F.lit(last), 1)), 1)
    dealt = held.withColumn(
        "period",
        F.explode(F.sequence(_period(F.greatest("since", F.lit(first))), _period(F.least(ends, F.lit(last))))),
    )
    asked = captures.where(F.col(day).isNotNull()).select(
        _ID, F.col(day).alias("_day"), _period(F.col(day)).alias("period"), F.explode(questions(F.col(url), lengths)).alias("q")
    ).select(_ID, "_day", "period", "q.kind", "q.value")
    found = (
        asked.join(dealt, ["kind", "value", "period"])
        .where((F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
        .groupBy(_ID)
        .agg(
            F.sort_array(F.collect_set(F.concat_ws(":", "list", "value"))).alias("matches"),  # of one url
            F.bool_or(F.col("list") == ALLOW).alias("_allowed"), F.bool_or(F.col("list") != ALLOW).alias("_listed"),
        )
    )
    return (
        captures.join(found, _ID, "left")
        .withColumns({
            "matches": F.coalesce("matches", F.array().cast("array<string>")),
            "blocked": F.coalesce(F.col("_listed") & ~F.col("_allowed"), F.lit(False)),
        })
        .drop(_ID, "_allowed", "_listed")
    )
