"""Dates found in free text and numbers made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The written forms of dates; full, with a two-digit year, year and month.
FULL = r"(\d{4})[年/.-](\d{1,2})[月/.-](\d{1,2})日?"
SHORT = r"'?(\d{2})[./年-](\d{1,2})[./月-](\d{1,2})日?"
MONTH = r"(\d{4})[年/.-](\d{1,2})月"


def date_candidate(text: Column, pivot: int = 70) -> Column:
    """The first full date, else the first with a short year (above pivot: 19yy), else a year and month (day 1), as text;
    numbers aren't checked for being a day of the calendar."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i).cast("int")
    put = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    yy = part(SHORT, 1)
    return (
        F.when(text.rlike(FULL), put(part(FULL, 1), part(FULL, 2), part(FULL, 3)))
        .when(text.rlike(SHORT), put(F.when(yy > pivot, 1900 + yy).otherwise(2000 + yy), part(SHORT, 2), part(SHORT, 3)))
        .when(text.rlike(MONTH), put(part(MONTH, 1), part(MONTH, 2), F.lit(1)))
    )


def float_year(date: Column) -> Column:
    """y + (m - 1) / 12 + (d - 1) / 365; 0 where there is no date."""
    y, m, d = (F.split_part(date, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.coalesce(y + (m - 1) / 12.0 + (d - 1) / 365.0, F.lit(0.0))


def day_number(date: Column) -> Column:
    """yyyymmdd, null where there is no date."""
    y, m, d = (F.split_part(date, F.lit("-"), F.lit(i)).try_cast("bigint") for i in (1, 2, 3))
    return y * 10000 + m * 100 + d


def comment_date(html: Column) -> Column:
    """The first date that any comment holds."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?s)<!--(.*?)-->"), F.lit(1)), date_candidate)
    return F.try_element_at(F.filter(found, lambda d: d.isNotNull()), F.lit(1))
