"""Dates, timestamps and the days-since-enrolment axis.

Instants are kept as ``timestamp_ntz`` in UTC, so no result depends on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch() -> Column:
    """Midnight of 1 January 1970."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_seconds_to_ts(column: Column | str) -> Column:
    """Seconds since 1970 (fractions kept) to a UTC instant; null stays null."""
    seconds = _column(column).cast("decimal(18,6)")
    return epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def text_to_ts(column: Column | str, pattern: str | None = None) -> Column:
    """Text to a UTC instant; unreadable text becomes null."""
    value = _column(column)
    parsed = F.try_to_timestamp(value, F.lit(pattern)) if pattern else F.try_to_timestamp(value)
    return parsed.cast("timestamp_ntz")


def text_to_date(column: Column | str, pattern: str | None = None) -> Column:
    """Text to a date; unreadable text becomes null."""
    value = _column(column)
    return F.try_to_date(value, pattern) if pattern else F.try_to_date(value)


def seconds_between(end: Column | str, start: Column | str) -> Column:
    """Elapsed seconds as a double, whatever the unit the gap suggests."""
    gap = (_column(end) - _column(start)).cast("interval second")
    return gap.cast("decimal(18,6)").cast("double")


def day_in_study(day: Column | str, enrolled: Column | str, offset: int = 1) -> Column:
    """Whole days from enrolment to ``day``; with offset 1 the enrolment day is day 1."""
    return F.date_diff(_column(day), _column(enrolled)) + F.lit(offset)


def week_from_zero(day: Column | str) -> Column:
    """Week of a one-based day, counted so that day 7 already opens week 2."""
    return (F.floor(_column(day) / F.lit(7)) + F.lit(1)).cast("int")


def bin_of(day: Column | str, width: int) -> Column:
    """One-based bin of ``width`` days; days 1..width form bin 1."""
    return (F.floor((_column(day) - F.lit(1)) / F.lit(width)) + F.lit(1)).cast("int")


def bin_label(day: Column | str, width: int = 14) -> Column:
    """Axis label of a zero-based day: the first week of its biweek on every
    ``width``-th day, empty text elsewhere."""
    value = _column(day)
    week = (value / F.lit(width)) * F.lit(2) + F.lit(1)
    return F.when(F.pmod(value, F.lit(width)) == 0, week.cast("int").cast("string")).otherwise(F.lit(""))
