"""Dates in text and the states derived from them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefglass import config
from reefglass.functions.extract import month_number


#: Fixed value: day, month and year in words, with a time of day.
DAY_MONTH_YEAR = r"(\d{1,2})\s+([^\s\d]+)\s+(\d{4})(?:\s+(\d{1,2}):(\d{2}))?"


def parse_text_datetime(c: Column, time: Column | None = None) -> Column:
    """'D Month YYYY [HH:MM]' as a timestamp; 23:59 without a time; null for impossible dates and years outside 1990..2100."""
    p = DAY_MONTH_YEAR
    t = F.coalesce(c, F.lit(""))
    day, year = F.regexp_extract(t, p, 1).try_cast("int"), F.regexp_extract(t, p, 3).try_cast("int")
    hour, minute = F.regexp_extract(t, p, 4).try_cast("int"), F.regexp_extract(t, p, 5).try_cast("int")
    if time is not None:
        hour = F.coalesce(F.regexp_extract(F.coalesce(time, F.lit("")), r"(\d{1,2}):(\d{2})", 1).try_cast("int"), hour)
        minute = F.coalesce(F.regexp_extract(F.coalesce(time, F.lit("")), r"(\d{1,2}):(\d{2})", 2).try_cast("int"), minute)
    made = F.try_make_timestamp(year, month_number(F.regexp_extract(t, p, 2)), day, F.coalesce(hour, F.lit(23)), F.coalesce(minute, F.lit(59)), F.lit(0))
    return F.when(year.between(1990, 2100), made)


def deadline_state(c: Column, as_of: Column) -> Column:
    """closed, closing_soon (within seven calendar days) or open; null without a date."""
    left = F.datediff(c.cast("date"), as_of.cast("date"))
    return F.when(c.isNull(), F.lit(None)).when(left < 0, "closed").when(left <= config.CLOSING_SOON_DAYS, "closing_soon").otherwise("open")


def month_bounds(c: Column) -> Column:
    """struct(first, next_first, suffix) of a date's month."""
    first = F.trunc(c, "month")
    return F.struct(first.alias("first"), F.add_months(first, 1).alias("next_first"), F.date_format(first, "yyyy_MM").alias("suffix"))


def is_sane(c: Column, as_of: Column) -> Column:
    """A year from 2000 to ten years ahead."""
    return F.year(c).between(2000, F.year(as_of) + 10)


def retention_cutoff(as_of: Column, days: int = config.LOG_RETENTION_DAYS) -> Column:
    """First of the month of the day ``days`` before."""
    return F.trunc(F.date_sub(as_of.cast("date"), days), "month")
