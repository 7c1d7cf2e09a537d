"""Date and timestamp sequences that stay empty instead of failing when inverted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stepped(start: Column, end: Column, step: str) -> Column:
    """``sequence(start, end, step)`` with both ends; empty when start is after end."""
    steps = F.sequence(start, end, F.expr(f"interval {step}"))
    return F.when(start <= end, steps).otherwise(F.filter(F.array(start), lambda _: F.lit(False)))


def month_starts(start: Column, end: Column) -> Column:
    """First days of the months touched by [start, end)."""
    first = F.trunc(start.cast("date"), "MM").cast("date")
    last = F.date_sub(end.cast("date"), 1)
    return stepped(first, last, "1 month")


def parse_time(text: Column, *patterns: str) -> Column:
    """Timestamp by the first pattern that fits, null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(pattern)) for pattern in patterns])


def parse_date(text: Column, pattern: str = "d MMM yyyy") -> Column:
    """Date by pattern ('01 Nov 2022'), null when it does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end; also for timestamps without a zone."""
    return F.timestamp_diff("SECOND", start, end)
