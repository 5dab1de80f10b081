"""Clock arithmetic on times without zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_millis(at: Column) -> Column:
    """Cut to whole milliseconds, as a poll's clock is."""
    return F.date_trunc("MILLISECOND", at).cast("timestamp_ntz")


def millis_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def plus_millis(at: Column, millis: Column) -> Column:
    return at + F.make_dt_interval(secs=(millis / F.lit(1000)).cast("decimal(18,6)"))
