"""Date arithmetic that keeps the time of day, and ISO parsing with a fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# A full date, then perhaps a time of day, then perhaps Z or an offset.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def days_before(moment: Column, days: int | Column) -> Column:
    """``moment`` minus whole days; the time of day stays (``date_sub`` would drop it)."""
    return moment - F.make_dt_interval(days=F.lit(days))


def lookback_start(as_of: Column, hours: int) -> Column:
    """First instant of a feed's look-back: hours back, then cut to the day."""
    return F.date_trunc("day", as_of - F.make_dt_interval(hours=F.lit(hours)))


def parse_iso(text: Column, fallback: Column) -> Column:
    """ISO-8601 text (``Z``, offset or none, meaning UTC) as a timestamp, else ``fallback``.

    A full date is required: a bare time or year would be read as a moment of today or of that year.
    """
    return F.coalesce(F.when(text.rlike(ISO), F.try_to_timestamp(text)), fallback)


def weekday_name(moment: Column) -> Column:
    """Full English day name."""
    return F.date_format(moment, "EEEE")
