"""Column expressions over dates, and the date ranges the queries share.

``as_of`` is always explicit: a query never looks at the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: str | dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def mail_date(c: str | Column) -> Column:
    """Day of a mail-style date in its own offset: 'Mon, 15 Jan 2024 10:30:00 GMT', two-digit
    years, 'Monday, 15-Jan-24 10:30:00 GMT' and 'Mon Jan 15 10:30:00 2024'.

    Null where the text has another shape.
    """
    # day month year time, with a blank or '-' between; or month day time year
    usual = r"(?:^|[\s,])(\d{1,2})[\s-]([A-Za-z]{3})[a-z]*[\s-](\d{4}|\d{2})\s+\d{1,2}:\d{2}"
    reverse = r"(?:^|\s)([A-Za-z]{3})[a-z]*\s+(\d{1,2})\s+\d{1,2}:\d{2}(?::\d{2})?\s+(?:[A-Za-z]+\s+)?(\d{4})(?:\s|$)"

    def found(pattern: str, order: tuple[int, int, int]) -> Column:
        number, month, year = (F.regexp_extract(_col(c), pattern, i) for i in order)
        # two digits: 69 to 99 are of the last century
        century = F.when(year >= "69", "19").otherwise("20")
        full = F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)
        return F.try_to_date(F.concat_ws(" ", number, F.initcap(month), full), "d MMM yyyy")

    return F.coalesce(found(usual, (1, 2, 3)), found(reverse, (2, 1, 3)))


def feed_day(published: str | Column, as_of: str | dt.date | Column) -> Column:
    return F.coalesce(mail_date(published), as_date(as_of))


def lenient_date(c: str | Column) -> Column:
    """ISO text (a date, alone or before a time) or mail-style text -> date, else null."""
    iso = F.regexp_extract(_col(c), r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?)?\s*$", 1)
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), mail_date(c))


def week_key(c: str | Column) -> Column:
    """'2024-W05': weeks start on Monday, days before the first Monday are week 00."""
    d = _col(c)
    number = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("string")
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(number, 2, "0"))


def month_key(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def days_before(as_of: str | dt.date | Column, days: int) -> Column:
    return F.date_sub(as_date(as_of), days)


def percent_change(current: Column, previous: Column, digits: int) -> Column:
    """Half-even rounded change in percent; null where there is no positive previous value."""
    return F.when(previous > 0, F.bround((current - previous) / previous * 100, digits))


def date_range(
    df: DataFrame,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    column: str = "day",
) -> DataFrame:
    """Closed range; either end may be open."""
    if start is not None:
        df = df.filter(F.col(column) >= as_date(start))
    if end is not None:
        df = df.filter(F.col(column) <= as_date(end))
    return df


def last_days(
    df: DataFrame, as_of: str | dt.date, days: int, column: str = "day", until: str | dt.date | None = None
) -> DataFrame:
    """From ``days`` days before ``as_of`` on. Later rows count too (feeds date ahead) unless
    ``until`` closes the range."""
    return date_range(df, days_before(as_of, days), until, column)
