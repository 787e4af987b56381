"""Column expressions shared by the plans; all stay inside generated code."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Day = date | datetime | str

# Rows that a hinted broadcast may hold; larger sides are left to the planner.
BROADCAST_ROWS = 10_000


def as_day(value: Day) -> date:
    if isinstance(value, str):
        return date.fromisoformat(value)
    return value.date() if isinstance(value, datetime) else value


def midnight(day: Day, minus_days: int = 0) -> Column:
    """Start of a day as a zone-free literal, so that it is pushed to the scan."""
    return F.lit((as_day(day) - timedelta(days=minus_days)).isoformat()).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM").cast("timestamp_ntz")


def month_number(day: Column) -> Column:
    """Months since year 0; a difference of two counts month boundaries."""
    return F.year(day) * 12 + F.month(day)


def hour_index(ts: Column) -> Column:
    """Hours since 1970-01-01 on the wall clock, independent of the session zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def minute_index(ts: Column) -> Column:
    return hour_index(ts).cast("bigint") * 60 + F.minute(ts)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond precision."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def quotient(numerator: Column, denominator: Column) -> Column:
    """Double division; a zero denominator gives NULL."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0))


def mask_first_number(text: Column) -> Column:
    """Replace the first run of digits by ``N`` and leave later ones alone."""
    return F.regexp_replace(text, r"(?s)^(.*?)\d+", "$1N")


def flag_sum(condition: Column) -> Column:
    """Number of rows for which the condition holds, 0 rather than NULL."""
    return F.sum(F.when(condition, 1).otherwise(0))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a relation that is limited to so many rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def top_rows(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """Sorted rows, cut to ``limit`` when one is given."""
    ranked = df.orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)
