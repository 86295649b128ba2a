import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediasignals.functions import dates

AS_OF = dt.date(2024, 3, 9)


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("Mon, 15 Jan 2024 10:30:00 GMT", dt.date(2024, 1, 15)),
        ("Tue, 20 Feb 2024 14:00:00 -0600", dt.date(2024, 2, 20)),
        ("5 Mar 2024 09:15 +0100", dt.date(2024, 3, 5)),
        ("", AS_OF), (None, AS_OF), ("not a valid date", AS_OF), ("2024-01-15T10:30:00Z", AS_OF),
    ],
)
def test_feed_day(value, raw, day):
    assert value(dates.feed_day("x", AS_OF), x=raw) == day


def test_lenient_date(value):
    lenient = dates.lenient_date("x")
    assert value(lenient, x="2024-01-15T10:30:00Z") == dt.date(2024, 1, 15)
    assert value(lenient, x="Wed, 31 Dec 2025 20:18:49 GMT") == dt.date(2025, 12, 31)
    assert value(lenient, x="31/31/2024") is None


def test_week_key_equals_strftime(spark):
    start = dt.date(2018, 12, 20)
    days = [(start + dt.timedelta(days=i),) for i in range(2600)]
    rows = spark.createDataFrame(days, "d date").select("d", dates.week_key("d").alias("w"))
    for r in rows.collect():
        assert r["w"] == r["d"].strftime("%Y-W%W")


def test_percent_change_half_even(spark):
    row = spark.range(1).select(
        dates.percent_change(F.lit(105), F.lit(200), 0).alias("a"),
        dates.percent_change(F.lit(1), F.lit(0), 1).alias("b"),
        dates.percent_change(F.lit(3), F.lit(9), 1).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (round(-47.5), None, -66.7)


def test_last_days_has_an_open_end(spark):
    rows = spark.createDataFrame([(AS_OF - dt.timedelta(days=i),) for i in range(-2, 10)], "day date")
    assert dates.last_days(rows, AS_OF, 7).count() == 10
    assert dates.last_days(rows, AS_OF, 7, until=AS_OF).count() == 8


def test_other_mail_dates(value):
    for raw in ("Mon, 15 Jan 24 10:30:00 GMT", "Monday, 15-Jan-24 10:30:00 GMT", "Mon Jan 15 10:30:00 2024"):
        assert value(dates.mail_date("x"), x=raw) == dt.date(2024, 1, 15), raw
    assert value(dates.mail_date("x"), x="Tue, 01 Feb 94 08:00 GMT") == dt.date(1994, 2, 1)
    assert value(dates.lenient_date("x"), x="2024-01-15garbage") is None
    assert value(dates.lenient_date("x"), x="2024-01-15 10:30") == dt.date(2024, 1, 15)
