"""Figures served from stored rollups: the same answers as from rows, read from day partitions.

The rollups of a data folder are written once in a session, as the daily run would have left them;
the queries then read only the partitions of the days they ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas
from ..operators import counts, rollup, trends
from ..session import shared_dir
from ..sources import tables
from .registry import CHECKS, query
from .sql import n_where
from .views import SERIES_AS_OF, Tables

_STORED: dict[tuple[str, str, str], str] = {}
_SCHEMAS = {"daily_global": schemas.DAILY_GLOBAL, "daily_source": schemas.DAILY_SOURCE}


def stored(t: Tables, name: str) -> DataFrame:
    """A rollup of the series view, stored by day."""
    at = (t.spark.sparkContext.applicationId, t.folder, name)
    if at not in _STORED:
        path = shared_dir(t.spark, name)
        tables.replace_all(getattr(rollup, name)(t("series")), path)
        _STORED[at] = path
    return tables.read_rollup(t.spark, _STORED[at], _SCHEMAS[name])


@query("b9_stored_metrics", CHECKS["b9_global_metrics"])
def b9(t):
    return counts.global_metrics(stored(t, "daily_global"), "2024-01-15")


@query("b16_stored_source_series", f"""
    select day, source, count(*) as n_articles, {n_where('relevant = 1')} as n_relevant,
           {n_where('risk = 1')} as n_risk, {n_where('opportunity = 1')} as n_opportunity
    from series where source is not null and day >= date '{SERIES_AS_OF}' - 7 group by day, source""")
def b16(t):
    return counts.source_series(stored(t, "daily_source"), SERIES_AS_OF, 7)


@query("d29_stored_compare", CHECKS["d29_compare_with_previous"])
def d29(t):
    return trends.compare_with_previous(stored(t, "daily_global"), SERIES_AS_OF, 7)


@query("d30_stored_day_over_day", CHECKS["d30_day_over_day"])
def d30(t):
    return trends.day_over_day(stored(t, "daily_global"))


@query("d31_stored_kpis", CHECKS["d31_kpis"])
def d31(t):
    return trends.kpis(stored(t, "daily_global"), "2024-01-05", "2024-01-25", SERIES_AS_OF)


@query("d49_stored_anomalies", CHECKS["d49_anomalies"])
def d49(t):
    return trends.anomalies(stored(t, "daily_global"), SERIES_AS_OF, 30, 1.5)
