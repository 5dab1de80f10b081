"""Keyed changes of the event table, as set operations.

A command row is (event_id, seq, action, at, next_at, error). Commands of one event apply in the order of seq, as each
may close the event to those after it: done and dead events ignore every mark, and only
dead ones can be replayed. The fold runs inside each event's row, over its own commands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relayloom.schema import MAX_ERROR_CHARS, Status

COMMANDS = "event_id string, seq long, action string, at timestamp_ntz, next_at timestamp_ntz, error string"
DONE, RETRY, DEFER, DEAD, REPLAY = ACTIONS = ("done", "retry", "defer", "dead", "replay")
STATE = ("status", "attempts", "available_at", "done_at", "last_error", "locked_by", "locked_at")


def truncate_error(error: Column, most: int = MAX_ERROR_CHARS) -> Column:
    return F.when(F.length(error) > most, F.concat(F.substring(error, 1, most - 3), F.lit("..."))).otherwise(error)


def cut(error: str | None, most: int = MAX_ERROR_CHARS) -> str | None:
    """truncate_error for a text of the driver."""
    return error[: most - 3] + "..." if error is not None and len(error) > most else error


def _applies(status: Column, action: Column) -> Column:
    return F.when(action == REPLAY, status == int(Status.DEAD)).otherwise(~status.isin(int(Status.DONE), int(Status.DEAD)))


def _next(s: dict[str, Column], c: dict[str, Column]) -> dict[str, Column]:
    """The state after a command that applies."""
    action, null = c["action"], F.lit(None)
    ended, later = action.isin(DONE, DEAD), action.isin(RETRY, DEFER)
    status = F.when(action == DONE, int(Status.DONE)).when(action == DEAD, int(Status.DEAD)).when(action == REPLAY, int(Status.NEW)).otherwise(int(Status.RETRY))
    return {
        "status": status,
        "attempts": F.when(action == RETRY, s["attempts"] + 1).when(action == REPLAY, 0).otherwise(s["attempts"]),
        "available_at": F.when(later, c["next_at"]).when(action == REPLAY, c["at"]).otherwise(s["available_at"]),
        "done_at": F.when(ended, c["at"]).when(action == REPLAY, null).otherwise(s["done_at"]),
        "last_error": F.when(action.isin(RETRY, DEAD), truncate_error(c["error"])).when(action == REPLAY, null).otherwise(s["last_error"]),
        "locked_by": null.cast("string"),
        "locked_at": null.cast("timestamp_ntz"),
    }


_CAST = {"status": "int", "attempts": "int", "available_at": "timestamp_ntz", "done_at": "timestamp_ntz", "last_error": "string", "locked_by": "string", "locked_at": "timestamp_ntz"}


def _step(s: Column, c: Column) -> Column:
    fields = {n: s[n] for n in STATE}
    made = _next(fields, {n: c[n] for n in ("action", "at", "next_at", "error")})
    hit = _applies(s["status"], c["action"])
    parts = [F.when(hit, made[n].cast(_CAST[n])).otherwise(s[n]).alias(n) for n in STATE]
    return F.struct(*parts, (s["applied"] + hit.cast("int")).alias("applied"))


def transition(events: DataFrame, commands: DataFrame) -> DataFrame:
    """The table after all commands, and `applied`: how many of them took effect on each event.

    Commands are gathered by event; an event has few, and the table is shuffled once, by event_id."""
    own = commands.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "at", "next_at", "error"))).alias("__commands"))
    joined = events.join(own, "event_id", "left")
    start = F.struct(*[F.col(n).cast(_CAST[n]).alias(n) for n in STATE], F.lit(0).alias("applied"))
    folded = joined.withColumn("__state", F.when(F.col("__commands").isNotNull(), F.aggregate("__commands", start, _step)).otherwise(start))
    return folded.select(*[F.col(f"__state.{n}").alias(n) if n in STATE else F.col(n) for n in events.columns], F.col("__state.applied").alias("applied"))


def mark(events: DataFrame, ids: DataFrame, action: str, at=None, next_at=None, error: Column | None = None) -> DataFrame:
    """The table after one action on each event of ids (event_id); terminal events stay as they are."""
    if action not in ACTIONS:
        raise ValueError(f"no such action: {action}")
    time = lambda x: F.lit(None).cast("timestamp_ntz") if x is None else x if isinstance(x, Column) else F.lit(str(x)).cast("timestamp_ntz")
    command = {"action": F.lit(action), "at": time(at), "next_at": time(next_at), "error": F.lit(None).cast("string") if error is None else error}
    joined = events.join(ids.select("event_id").distinct().withColumn("__hit", F.lit(True)), "event_id", "left")
    hit = F.col("__hit").isNotNull() & _applies(F.col("status"), command["action"])
    made = _next({n: F.col(n) for n in STATE}, command)
    return joined.select(*[F.when(hit, made[n].cast(_CAST[n])).otherwise(F.col(n)).alias(n) if n in STATE else F.col(n) for n in events.columns])


def affected(events: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows that each action would change, as a database counts updates; commands taken one by one, not folded."""
    return commands.join(events.select("event_id", "status"), "event_id").where(_applies(F.col("status"), F.col("action"))).groupBy("action").agg(F.count("*").alias("n_rows"))


def replay_all(events: DataFrame, now, event_type: str | None = None, aggregate_type: str | None = None, batch: int = 100) -> DataFrame:
    """The table after every matching dead event has been replayed. In batches or at once the result is the same, so it is one projection."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    hit = F.col("status") == int(Status.DEAD)
    if event_type is not None:
        hit &= F.col("event_type") == event_type
    if aggregate_type is not None:
        hit &= F.col("aggregate_type") == aggregate_type
    at = F.lit(str(now)).cast("timestamp_ntz")
    command = {"action": F.lit(REPLAY), "at": at, "next_at": at, "error": F.lit(None).cast("string")}
    made = _next({n: F.col(n) for n in STATE}, command)
    return events.select(*[F.when(hit, made[n].cast(_CAST[n])).otherwise(F.col(n)).alias(n) if n in STATE else F.col(n) for n in events.columns])
