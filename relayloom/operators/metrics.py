"""Counters and gauges, as aggregates over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relayloom.functions.times import millis_between, to_millis
from relayloom.schema import instant

COUNTERS = ("hot_enqueued", "hot_dropped", "hot_delayed", "cold_enqueued", "dispatch_success", "dispatch_failure", "dispatch_deferred", "dispatch_dead")


def oldest_lag(polled: DataFrame, now) -> DataFrame:
    """Milliseconds since the oldest polled event was made; 0 for an empty batch or one of the future."""
    lag = F.max(millis_between(F.col("created_at"), instant(now)))
    return polled.agg(F.greatest(F.coalesce(lag, F.lit(0)), F.lit(0)).cast("long").alias("oldest_lag_ms"))


def queue_depths(queued: DataFrame) -> DataFrame:
    return queued.groupBy("source").agg(F.count("*").alias("depth"))


def counters(split: DataFrame, polled: DataFrame, commands: DataFrame) -> DataFrame:
    """The eight counters of a cycle: fates of fresh events (`fate`), polled rows, actions of commands."""
    of = lambda c, v, n: F.count(F.when(F.col(c) == v, 1)).alias(n)
    hot = split.agg(of("fate", "accepted", COUNTERS[0]), of("fate", "dropped", COUNTERS[1]), of("fate", "delayed", COUNTERS[2]))
    cold = polled.agg(F.count("*").alias(COUNTERS[3]))
    ends = commands.agg(of("action", "done", COUNTERS[4]), of("action", "retry", COUNTERS[5]), of("action", "defer", COUNTERS[6]), of("action", "dead", COUNTERS[7]))
    return hot.crossJoin(cold).crossJoin(ends)  # one row each


def dispatch_latency(done: DataFrame, start: str = "created_at", end: str = "done_at") -> DataFrame:
    """Of delivered events, those with a latency of 0 or more: count, sum, largest; a difference of clocks in milliseconds."""
    ms = millis_between(to_millis(F.col(start)), to_millis(F.col(end)))
    return done.select(ms.alias("ms")).where("ms >= 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("ms"), F.lit(0)).alias("sum_ms"), F.max("ms").alias("max_ms"))
