"""Write side: envelope rules, defaults, suppression, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from relayloom.functions.headers import CODEC, Codec
from relayloom.functions.ids import ulid
from relayloom.operators.ranks import numbered
from relayloom.schema import COLUMNS, EVENTS, GLOBAL, MAX_PAYLOAD_BYTES, ORDER, Status

#: Error codes in the order in which a builder meets them.
RULES = ("event_type_missing", "event_type_empty", "two_delivery_times", "delay_not_positive", "available_before_occurred", "header_null", "payload_count", "payload_too_large")


def envelope_error(envelopes: DataFrame | None = None) -> Column:
    """The first broken rule of a row of schema.ENVELOPES, or null."""
    occurred = F.col("occurred_at")
    kinds = F.col("payload_json").isNotNull().cast("int") + F.col("payload_bytes").isNotNull().cast("int")
    size = F.coalesce(F.octet_length("payload_json"), F.octet_length("payload_bytes"))
    conditions = (
        F.col("event_type").isNull(),
        F.col("event_type") == "",
        F.col("available_at").isNotNull() & F.col("deliver_after_ms").isNotNull(),
        F.col("deliver_after_ms") <= 0,
        F.col("available_at") < occurred,
        F.exists(F.map_values("headers"), lambda v: v.isNull()),
        kinds != 1,
        size > MAX_PAYLOAD_BYTES,
    )
    out = F.when(conditions[0], RULES[0])
    for rule, broken in zip(RULES[1:], conditions[1:]):
        out = out.when(broken, rule)
    return out


def validate(envelopes: DataFrame, now) -> DataFrame:
    """envelopes with error (null: valid); a missing occurred_at is now."""
    at = F.lit(str(now)).cast("timestamp_ntz")
    return envelopes.withColumn("occurred_at", F.coalesce("occurred_at", at)).withColumn("error", envelope_error())


def deliver_after(at: Column, millis: Column) -> Column:
    return at + F.make_dt_interval(secs=(millis / F.lit(1000)).cast("decimal(18,6)"))


def normalize(envelopes: DataFrame, now, codec: Codec = CODEC) -> DataFrame:
    """Valid envelopes as new rows of the event table; missing ids are made, so results with them vary."""
    good = validate(envelopes, now).where(F.col("error").isNull())
    available = F.when(F.col("deliver_after_ms").isNotNull(), deliver_after(F.col("occurred_at"), F.col("deliver_after_ms"))).otherwise(F.coalesce("available_at", "occurred_at"))
    made = {
        "event_id": F.coalesce("event_id", ulid(F.col("occurred_at"))),
        "aggregate_type": F.coalesce("aggregate_type", F.lit(GLOBAL)),
        "payload": F.coalesce("payload_json", F.decode("payload_bytes", "UTF-8")),
        "headers": codec.encode(F.col("headers")),
        "status": F.lit(int(Status.NEW)),
        "attempts": F.lit(0),
        "available_at": available,
        "created_at": F.col("occurred_at"),
        "done_at": F.lit(None),
        "last_error": F.lit(None),
        "locked_by": F.lit(None),
        "locked_at": F.lit(None),
    }
    return good.select(*[made.get(n, F.col(n)).cast(EVENTS[n].dataType).alias(n) for n in COLUMNS])


def chunked(events: DataFrame, size: int = 500, per: str | None = None) -> DataFrame:
    """events with the number of the insert statement that would carry each; numbered within `per`, a
    batch column, so that batches are numbered side by side, or over all rows by range."""
    return numbered(events, ORDER, per).withColumn("chunk", F.floor(F.col("rank") / size).cast("long")).drop("rank")


class WriterHook:
    """What a caller may do around a write; each method may be overridden."""

    def before_write(self, events: DataFrame) -> DataFrame | None:
        """What to write instead; None suppresses the write."""
        return events

    def after_write(self, events: DataFrame) -> None: ...

    def after_commit(self, events: DataFrame) -> None: ...

    def after_rollback(self, events: DataFrame) -> None: ...


def write(events: DataFrame, sink: Callable[[DataFrame], None], hooks: Iterable[WriterHook] = ()) -> DataFrame:
    """Transform, store, call back; returns the ids written, none if a hook suppressed the batch.

    Once per batch: a hook sees the whole batch, and a failing sink calls after_rollback and raises."""
    hooks, now = list(hooks), events
    for hook in hooks:
        now = hook.before_write(now)
        if now is None:
            return events.limit(0).select("event_id")
    try:
        sink(now)
        for hook in hooks:
            hook.after_write(now)
    except Exception:
        for hook in hooks:
            hook.after_rollback(now)
        raise
    for hook in hooks:
        hook.after_commit(now)
    return now.select("event_id")
