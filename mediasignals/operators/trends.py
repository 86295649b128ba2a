"""Weekly and monthly rollups, period comparisons, anomalies. All read daily rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, days_before, last_days, month_key, percent_change, week_key
from .counts import topic_names

METRICS = ("n_articles", "n_relevant", "n_risk", "n_opportunity")


def _sums(*extra: str) -> list[Column]:
    return [F.sum(m).alias(m) for m in (*METRICS, *extra)]


def weekly_totals(daily_global: DataFrame, as_of: str | dt.date, weeks: int = 12) -> DataFrame:
    return (
        last_days(daily_global, as_of, weeks * 7)
        .groupBy(week_key("day").alias("week"))
        .agg(*_sums("n_mixed"), F.avg("n_sources").alias("avg_sources"))
        .orderBy("week")
    )


def monthly_totals(daily_global: DataFrame, as_of: str | dt.date, months: int = 12) -> DataFrame:
    """A month counts as 31 days when looking back."""
    return (
        last_days(daily_global, as_of, months * 31)
        .groupBy(month_key("day").alias("month"))
        .agg(
            *_sums("n_mixed"), F.avg("n_sources").alias("avg_sources"),
            F.count("*").alias("days_with_data"),
        )
        .orderBy("month")
    )


def weekly_topics(
    daily_topic: DataFrame, topics: DataFrame, as_of: str | dt.date, weeks: int = 12
) -> DataFrame:
    per_id = (
        last_days(daily_topic, as_of, weeks * 7)
        .groupBy(week_key("day").alias("week"), "topic_id")
        .agg(*[F.sum(m).alias(m) for m in ("n_articles", "n_risk", "n_opportunity")])
    )
    return (
        topic_names(per_id, topics)
        .groupBy("week", "topic")
        .agg(*[F.sum(m).alias(m) for m in ("n_articles", "n_risk", "n_opportunity")])
        .orderBy("week", "topic")
    )


Period = tuple[str | dt.date | Column, str | dt.date | Column]


def _sum_in(metric: str, period: Period) -> Column:
    inside = F.col("day").between(as_date(period[0]), as_date(period[1]))
    return F.coalesce(F.sum(F.when(inside, F.col(metric))), F.lit(0))


def compare_periods(daily_global: DataFrame, current: Period, previous: Period) -> DataFrame:
    """One row: sums of both closed periods and the change in percent, in a single scan."""
    in_either = [F.col("day").between(as_date(p[0]), as_date(p[1])) for p in (current, previous)]
    sums = daily_global.filter(in_either[0] | in_either[1]).agg(
        *[_sum_in(m, current).alias(f"cur_{m}") for m in METRICS],
        *[_sum_in(m, previous).alias(f"prev_{m}") for m in METRICS],
    )
    changes = [
        percent_change(F.col(f"cur_{m}"), F.col(f"prev_{m}"), 1).alias(f"pct_{m}") for m in METRICS
    ]
    return sums.select("*", *changes)


def compare_with_previous(daily_global: DataFrame, as_of: str | dt.date, days: int = 7) -> DataFrame:
    """Last ``days`` days against as many before."""
    current = (days_before(as_of, days - 1), as_date(as_of))
    previous = (days_before(as_of, 2 * days - 1), days_before(as_of, days))
    return compare_periods(daily_global, current, previous)


def day_over_day(daily_global: DataFrame) -> DataFrame:
    """Change against the calendar day before; only days whose previous day has a rollup.

    A rollup has one row per day, so this is an equi-join of two short tables and needs no
    global ordering.
    """
    metrics = ("n_articles", "n_risk", "n_opportunity")
    before = daily_global.select(
        F.date_add("day", 1).alias("day"), *[F.col(m).alias(f"prev_{m}") for m in metrics]
    )
    changes = [
        percent_change(
            F.coalesce(m, F.lit(0)), F.coalesce(f"prev_{m}", F.lit(0)), 1
        ).alias(f"pct_{m}")
        for m in metrics
    ]
    return daily_global.select("day", *metrics).join(before, "day").select("day", *changes)


def kpis(
    daily_global: DataFrame, start: str | dt.date, end: str | dt.date, as_of: str | dt.date
) -> DataFrame:
    """Totals of a range, and the last 8 days against the 7 before (whole percent)."""
    chosen = (start, end)
    current = (days_before(as_of, 7), as_date(as_of))
    previous = (days_before(as_of, 14), days_before(as_of, 8))
    deltas = ("n_articles", "n_risk", "n_opportunity")
    needed = F.col("day").between(as_date(start), as_date(end)) | F.col("day").between(
        days_before(as_of, 14), as_date(as_of)
    )
    sums = daily_global.filter(needed).agg(
        *[_sum_in(m, chosen).alias(m) for m in (*METRICS, "n_deep")],
        *[_sum_in(m, current).alias(f"_cur_{m}") for m in deltas],
        *[_sum_in(m, previous).alias(f"_prev_{m}") for m in deltas],
    )
    pct = [
        percent_change(F.col(f"_cur_{m}"), F.col(f"_prev_{m}"), 0).cast("long").alias(f"delta_{m}")
        for m in deltas
    ]
    return sums.select(*METRICS, "n_deep", *pct)


def kpis_from_articles(articles: DataFrame, as_of: str | dt.date) -> DataFrame:
    """The same kind of block straight from article rows.

    Here the previous window is half open and a risk or opportunity base below 1 counts as
    1; without any article in the previous week there are no changes at all.
    """
    day = F.col("day")
    cur = day.between(days_before(as_of, 7), as_date(as_of))
    prev = (day >= days_before(as_of, 14)) & (day < days_before(as_of, 7))
    sums = articles.agg(
        F.count("*").alias("n_articles"),
        F.count_if(F.col("risk") == 1).alias("n_risk"),
        F.count_if(F.col("opportunity") == 1).alias("n_opportunity"),
        F.coalesce(F.sum("deep_analysis"), F.lit(0)).alias("n_deep"),
        F.count_if(cur).alias("_cn"), F.count_if(prev).alias("_pn"),
        *[
            F.coalesce(F.sum(F.when(w, F.col(m))), F.lit(0)).alias(f"{p}{m}")
            for p, w in (("_c_", cur), ("_p_", prev))
            for m in ("risk", "opportunity")
        ],
    )

    def floored(metric: str) -> Column:
        c, p = F.col(f"_c_{metric}"), F.col(f"_p_{metric}")
        change = F.bround((c - p) / F.greatest(p, F.lit(1)) * 100, 0)
        return F.when(F.col("_pn") > 0, change).cast("long")

    return sums.select(
        "n_articles", "n_risk", "n_opportunity", "n_deep",
        percent_change(F.col("_cn"), F.col("_pn"), 0).cast("long").alias("delta_n_articles"),
        floored("risk").alias("delta_n_risk"),
        floored("opportunity").alias("delta_n_opportunity"),
    )


def anomalies(
    daily_global: DataFrame, as_of: str | dt.date, days: int = 30, sigma: float = 2.0
) -> DataFrame:
    """Days whose metric lies more than ``sigma`` sample deviations from the window mean."""
    metrics = ["n_articles", "n_risk", "n_opportunity"]
    window = last_days(daily_global, as_of, days).select("day", *metrics)
    long = window.unpivot("day", metrics, "metric", "value")
    # one row per metric name above: three rows whatever the data
    stats = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation")
    )
    scored = long.join(F.broadcast(stats), "metric").filter("deviation > 0")
    band = F.lit(sigma) * F.col("deviation")
    outside = scored.withColumn(
        "direction",
        F.when(F.col("value") > F.col("mean") + band, "alto").when(
            F.col("value") < F.col("mean") - band, "bajo"
        ),
    ).filter("direction is not null")
    return outside.select(
        "day", "metric", "value",
        F.bround("mean", 1).alias("mean"), F.bround("deviation", 1).alias("deviation"),
        "direction",
        F.bround((F.col("value") - F.col("mean")) / F.col("deviation"), 2).alias("z"),
    ).orderBy(F.desc("day"), "metric")
