"""Reads of the event table. Filters reach the scan; top-k reads never sort the whole table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from relayloom.schema import ORDER, POLLED, Status, instant, pending, status_name


def _minus(at: Column, by: timedelta | None) -> Column:
    return at if by is None else at - F.make_dt_interval(secs=F.lit(by / timedelta(seconds=1)).cast("decimal(18,6)"))


def due(events: DataFrame, now) -> DataFrame:
    """Pending events whose time has come (a time equal to now has come)."""
    return events.where(pending() & (F.col("available_at") <= instant(now)))


def delayed(events: DataFrame) -> DataFrame:
    """Events that were to be delivered strictly later than they were made."""
    return events.where(F.coalesce(F.col("available_at") > F.col("created_at"), F.lit(False)))


def poll_pending(events: DataFrame, now, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
    """The oldest due events; locks don't matter to a poll. Events made after now - skip_recent stay out."""
    ready = due(events, now).where(F.col("created_at") <= _minus(instant(now), skip_recent))
    return ready.orderBy(*ORDER).limit(max(limit, 0)).select(*POLLED)


def claimable(events: DataFrame, now, lock_expiry, skip_recent: timedelta | None = None) -> DataFrame:
    """Due events without an owner, or whose lock is strictly older than lock_expiry."""
    free = F.col("locked_by").isNull() | (F.col("locked_at") < instant(lock_expiry))
    return due(events, now).where(F.col("created_at") <= _minus(instant(now), skip_recent)).where(free)


def claim_pending(events: DataFrame, owner: str, now, lock_expiry, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
    """What a claim by owner hands on, oldest first."""
    return claimable(events, now, lock_expiry, skip_recent).orderBy(*ORDER).limit(max(limit, 0)).select(*POLLED)


def claim_rows(events: DataFrame, owner: str, now, lock_expiry, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
    """The events that a claim by owner takes, as they are after it."""
    chosen = claimable(events, now, lock_expiry, skip_recent).orderBy(*ORDER).limit(max(limit, 0))
    return chosen.withColumns({"locked_by": F.lit(owner), "locked_at": instant(now)})


def claim_marks(events: DataFrame, owner: str, now, lock_expiry, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
    """The whole table after the claim: chosen events carry owner and now. The chosen ids are at most
    `limit` rows, so the join needs no shuffle of the table."""
    chosen = claimable(events, now, lock_expiry, skip_recent).orderBy(*ORDER).limit(max(limit, 0)).select("event_id", F.lit(True).alias("chosen"))
    joined = events.join(chosen, "event_id", "left")
    mark = F.col("chosen").isNotNull()
    return joined.withColumns({"locked_by": F.when(mark, F.lit(owner)).otherwise(F.col("locked_by")), "locked_at": F.when(mark, instant(now)).otherwise(F.col("locked_at"))}).select(*events.columns)


def select_claimed(events: DataFrame, owner: str, locked_at) -> DataFrame:
    """Events that owner locked at exactly that time."""
    return events.where((F.col("locked_by") == owner) & (F.col("locked_at") == instant(locked_at))).orderBy(*ORDER).select(*POLLED)


def dead(events: DataFrame, event_type: str | None = None, aggregate_type: str | None = None) -> DataFrame:
    out = events.where(F.col("status") == int(Status.DEAD))
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    if aggregate_type is not None:
        out = out.where(F.col("aggregate_type") == aggregate_type)
    return out


def query_dead(events: DataFrame, limit: int, event_type: str | None = None, aggregate_type: str | None = None) -> DataFrame:
    return dead(events, event_type, aggregate_type).orderBy(*ORDER).limit(max(limit, 0)).select(*POLLED)


def count_dead(events: DataFrame, event_type: str | None = None) -> DataFrame:
    return dead(events, event_type).agg(F.count("*").alias("n_dead"))


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def recent(events: DataFrame, limit: int = 20) -> DataFrame:
    """The newest events, for listings."""
    return events.orderBy(F.col("created_at").desc(), F.col("event_id")).limit(limit)


def with_status_name(events: DataFrame) -> DataFrame:
    return events.withColumn("status_name", status_name(F.col("status")))


def dedupe(events: DataFrame) -> DataFrame:
    """The first row of each event_id, for consumers of an append-only feed. Copies are reduced before the shuffle."""
    rest = F.struct(*[c for c in events.columns if c != "event_id"])
    # Copies made at one time are told apart by their other columns, so that the choice doesn't depend on the order of rows.
    plain = [f.name for f in events.schema.fields if "map<" not in f.dataType.simpleString()]
    first = F.min_by(rest, F.struct("created_at", F.xxhash64(*plain)))
    return events.groupBy("event_id").agg(first.alias("r")).select("event_id", "r.*")
