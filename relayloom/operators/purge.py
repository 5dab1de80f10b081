"""Retention: which rows go, and what stays. A purge rewrites the survivors; it updates nothing in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relayloom.schema import ORDER, instant, terminal


def ended_before(cutoff) -> Column:
    """Terminal and strictly older, by done_at or, where that is missing, by created_at. Two branches
    instead of a coalesce, so that the scan can use them."""
    at = instant(cutoff)
    return terminal() & ((F.col("done_at") < at) | (F.col("done_at").isNull() & (F.col("created_at") < at)))


def made_before(cutoff) -> Column:
    """Strictly older, whatever the status."""
    return F.col("created_at") < instant(cutoff)


def candidates(events: DataFrame, rule: Column, limit: int) -> DataFrame:
    """Ids of one purge batch, the oldest first."""
    return events.where(rule).orderBy(*ORDER).limit(max(limit, 0)).select("event_id")


def survivors(events: DataFrame, rule: Column, limit: int) -> DataFrame:
    """The table after one batch; the batch is bounded by limit, so it is the side to broadcast."""
    return events.join(candidates(events, rule, limit), "event_id", "left_anti")


def drain(events: DataFrame, rule: Column) -> DataFrame:
    """The table after batches until none is full: one filter."""
    return events.where(~F.coalesce(rule, F.lit(False)))
