"""From polled or fresh events to commands: queues, dedupe, routing, outcomes, backoff."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from relayloom.functions.headers import CODEC, Codec
from relayloom.functions.times import plus_millis, to_millis
from relayloom.operators.ingest import RULES
from relayloom.operators.ranks import numbered, ranked  # noqa: F401
from relayloom.operators.routing import route
from relayloom.operators.scans import poll_pending
from relayloom.schema import MAX_PAYLOAD_BYTES, ORDER, instant

HOT, COLD = "HOT", "COLD"


class RetryAfter(Exception):
    """Raised by a handler that knows when it wants the event again; counts as an attempt."""

    def __init__(self, delay_ms: int, reason: str = ""):
        if delay_ms is None or delay_ms < 0:
            raise ValueError("delay must be 0 or more")
        super().__init__(reason or f"retry after {delay_ms} ms")
        self.delay_ms = delay_ms


@dataclass(frozen=True)
class Result:
    """A handler's answer: done, or again after a delay without counting an attempt."""

    delay_ms: int | None = None

    def __post_init__(self):
        if self.delay_ms is not None and self.delay_ms < 0:
            raise ValueError("delay must be 0 or more")


DONE = Result()


def accept(events: DataFrame, capacity: int) -> DataFrame:
    """The events that a bounded queue takes; the rest is dropped, and found again by a poll."""
    return events.orderBy(*ORDER).limit(max(capacity, 0))


def hot_split(events: DataFrame, capacity: int) -> DataFrame:
    """Fresh events with `fate`: delayed, accepted or dropped. Only the queue's size is ranked: the
    accepted ids are a top-k, at most `capacity` rows."""
    late = F.coalesce(F.col("available_at") > F.col("created_at"), F.lit(False))
    taken = accept(events.where(~late), capacity).select("event_id", F.lit(True).alias("__taken"))
    fate = F.when(late, "delayed").when(F.col("__taken").isNotNull(), "accepted").otherwise("dropped")
    return events.join(taken, "event_id", "left").withColumn("fate", fate).drop("__taken")


def fair_merge(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Both queues, each with `rank`, as one: two hot, one cold, and whatever is left when one ends.

    `position` orders them. For full queues the slot of a hot event is 3 * (rank div 2) + rank mod 2
    and that of a cold one 3 * rank + 2; an empty queue leaves its slots to the other, which keeps its own order."""
    half = F.floor(F.col("rank") / 2)
    a = hot.withColumns({"source": F.lit(HOT), "position": (3 * half + F.col("rank") % 2).cast("long")})
    b = cold.withColumns({"source": F.lit(COLD), "position": (3 * F.col("rank") + 2).cast("long")})
    return a.unionByName(b)


def inflight_dedupe(queued: DataFrame) -> DataFrame:
    """One queue element for each event: the hot one if there are several, then the oldest."""
    others = [c for c in queued.columns if c != "event_id"]
    first = F.min_by(F.struct(*others), F.struct(F.when(F.col("source") == HOT, 0).otherwise(1), "created_at"))
    return queued.groupBy("event_id").agg(first.alias("r")).select(*[F.col("event_id") if c == "event_id" else F.col(f"r.{c}").alias(c) for c in queued.columns])


def backoff_capped(n: Column, base_ms: int = 200, max_ms: int = 60_000) -> Column:
    """Milliseconds before jitter: base * 2^(n - 1), at most max; 0 for no attempt. Large n saturate."""
    shift = F.least(F.greatest(n - 1, F.lit(0)), F.lit(30)).cast("int")
    doubled = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    grown = F.when((n >= 31) | (doubled > (max_ms // base_ms if base_ms else 1 << 62)), F.lit(max_ms)).otherwise(F.lit(base_ms) * doubled)
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(grown, F.lit(max_ms))).cast("long")


def backoff_bounds(n: Column, base_ms: int = 200, max_ms: int = 60_000) -> tuple[Column, Column]:
    """Least delay, and the bound that jitter in [0.5, 1.5) stays below or, at max, reaches."""
    capped = backoff_capped(n, base_ms, max_ms)
    return F.floor(capped * 0.5).cast("long"), F.least(F.lit(max_ms), F.floor(capped * 1.5)).cast("long")


def backoff(n: Column, base_ms: int = 200, max_ms: int = 60_000, jitter: Column | None = None) -> Column:
    """Delay with jitter, a column of [0.5, 1.5); by default random."""
    spread = F.rand() + 0.5 if jitter is None else jitter
    return F.least(F.lit(max_ms), F.floor(backoff_capped(n, base_ms, max_ms) * spread)).cast("long")


def outcomes(delivered: DataFrame, now, max_attempts: int = 10, delay_ms: Column | None = None, *more: str) -> DataFrame:
    """Commands for handled events: rows with event_id, attempts, result (done, retry_after, failed, failed_after, unroutable)
    and, for the two with after, result_delay_ms; error is the failure's text.

    In this order: unroutable is dead at once; done is done; a wish for later defers; a failure that uses up the
    attempts is dead; another failure is a retry, after its own delay or the backoff. Interceptors run before the listener is looked
    up, so an event without one may have failed instead. Columns named in `more` come along."""
    at = instant(now)
    backoff_ms = backoff_capped(F.col("attempts") + 1) if delay_ms is None else delay_ms
    lost = F.col("result") == "unroutable"
    spent = F.col("attempts") + 1 >= max_attempts
    action = F.when(lost, "dead").when(F.col("result") == "done", "done").when(F.col("result") == "retry_after", "defer").when(spent, "dead").otherwise("retry")
    delay = F.when(F.col("result").isin("retry_after", "failed_after"), F.col("result_delay_ms")).otherwise(backoff_ms)
    error = F.when(lost, F.concat(F.lit("no listener for "), F.coalesce("aggregate_type", F.lit("__GLOBAL__")), F.lit("/"), F.col("event_type"))).when(action.isin("dead", "retry"), F.col("error"))
    return delivered.select("event_id", F.lit(0).cast("long").alias("seq"), action.alias("action"), at.alias("at"), F.when(action.isin("retry", "defer"), plus_millis(at, delay)).alias("next_at"), error.alias("error"), *more)


def decode(polled: DataFrame, codec: Codec = CODEC) -> DataFrame:
    """Polled rows with their headers as a map and `decode_error`: what the envelope rules or the header
    parser say. One pass; texts that the built-in parser reads exactly are null to the Python one."""
    rule = (
        F.when(F.col("event_type").isNull(), RULES[0])
        .when(F.col("event_type") == "", RULES[1])
        .when(F.col("available_at") < F.col("created_at"), RULES[4])
        .when(F.col("payload").isNull(), RULES[6])
        .when(F.octet_length("payload") > MAX_PAYLOAD_BYTES, RULES[7])
    )
    error = F.when(F.col("__d.error").isNotNull(), F.concat(F.lit("headers: "), F.col("__d.error")))
    decoded = polled.withColumn("__d", codec.decode(F.col("headers")))
    return decoded.withColumns({"header_map": F.col("__d.headers"), "decode_error": F.coalesce(error, rule)}).drop("__d")


@dataclass
class Interceptor:
    """Around a handler: `before` may raise, which fails the event; what `after` raises is ignored."""

    before: Callable[[dict], None] | None = None
    after: Callable[[dict, Exception | None], None] | None = None


def deliver(event: dict, handler: Callable[[dict], Result | None] | None, interceptors: Iterable[Interceptor] = ()) -> tuple[str, int | None, str | None]:
    """(result, delay, error) of one event. Interceptors run before the listener is looked at; only those
    whose before came through get after, in reverse."""
    entered, failure, answer = [], None, None
    try:
        for each in interceptors:
            if each.before:
                each.before(event)
            entered.append(each)
        if handler is None:
            return "unroutable", None, None
        answer = handler(event)
    except Exception as e:
        failure = e
    finally:
        for each in reversed(entered):
            if each.after:
                try:
                    each.after(event, failure)
                except Exception:  # an observer's failure is not the event's
                    pass
    if isinstance(failure, RetryAfter):
        return "failed_after", failure.delay_ms, str(failure)
    if failure is not None:
        return "failed", None, f"{type(failure).__name__}: {failure}"
    if answer is None or answer.delay_ms is None:
        return "done", None, None
    return "retry_after", answer.delay_ms, None


def handle(routed: DataFrame, handlers: dict[str, Callable[[dict], Result | None]], interceptors: Iterable[Interceptor] = ()) -> DataFrame:
    """routed with result, result_delay_ms, error and listener_ms (how long hooks and handler took; null if they failed);
    handlers run where the rows are, a batch at a time."""
    interceptors = list(interceptors)
    more = [T.StructField("result", T.StringType()), T.StructField("result_delay_ms", T.LongType()), T.StructField("error", T.StringType()), T.StructField("listener_ms", T.DoubleType())]
    schema = T.StructType([*routed.schema.fields, *more])

    def timed(row: dict) -> tuple:
        start = time.perf_counter()
        result, delay, error = deliver(row, handlers.get(row["listener"]), interceptors)
        return result, delay, error, None if error is not None else 1000 * (time.perf_counter() - start)

    def run(batches):
        for pdf in batches:
            made = [timed(r) for r in pdf.to_dict("records")]
            for k, field in enumerate(more):
                pdf[field.name] = [m[k] for m in made]
            pdf["result_delay_ms"] = pdf["result_delay_ms"].astype("Int64")
            yield pdf

    return routed.mapInPandas(run, schema)


def poll_cycle(events: DataFrame, routes: DataFrame, now, batch: int, capacity: int) -> DataFrame:
    """One poll: the clock cut to milliseconds, no more than the free capacity, decoded and routed.
    Rows with decode_error are to be marked dead; the others go to their listeners in order."""
    clock = to_millis(instant(now))
    return route(decode(poll_pending(events, clock, min(batch, capacity))), routes)
