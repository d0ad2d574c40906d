"""Calendar bins, durations and outage filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def week_ending(day: Column | str, weekday: str = "Mon") -> Column:
    """Label of the weekly bin that closes on the given weekday (the closing day belongs to the bin)."""
    return F.next_day(F.date_sub(as_col(day), 1), weekday)


def month_end(day: Column | str) -> Column:
    return F.last_day(as_col(day))


def ntz(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def micros_between(earlier: Column | str, later: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later))


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    return micros_between(earlier, later) / F.lit(1_000_000.0)


def plus_seconds(ts: Column | str, seconds: Column | int | float) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return as_col(ts) + F.make_dt_interval(secs=secs)


def in_range(ts: Column | str, start: datetime, end: datetime) -> Column:
    """Half-open time filter."""
    return (as_col(ts) >= ntz(start)) & (as_col(ts) < ntz(end))


def outside_outage(day: Column | str, start: datetime, end: datetime) -> Column:
    """Days before the outage or after its last full day; [start, end) is the outage."""
    d = as_col(day)
    return (d < F.lit(start.date())) | (d >= F.lit(end.date()))


def date_spine(spark, first: datetime, last: datetime, name: str = "day"):
    """One row per calendar day, both ends included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(first.date()), F.lit(last.date()))).alias(name)
    )
