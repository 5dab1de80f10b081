"""For tests of what is built on this library: a store in memory, hooks that keep notes, a whole stack in one call."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from relayloom.operators import ingest, purge, scans, transitions
from relayloom.schema import COLUMNS, EVENTS, Status
from relayloom.streaming import flows
from relayloom.streaming.exporters import Recorder


class MemoryStore:
    """The operations of `sources.store.EventStore` on a list of rows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.streams = spark, [], {}

    def read(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, EVENTS)

    def _keep(self, events: DataFrame) -> None:
        self.rows = [tuple(r) for r in events.select(*COLUMNS).collect()]

    def insert(self, events: DataFrame) -> None:
        self.rows = self.rows + [tuple(r) for r in events.select(*COLUMNS).collect()]

    def stage(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = self.spark.createDataFrame([tuple(r) for r in events.select(*COLUMNS).collect()], EVENTS)
        return rows, rows

    def commit(self, staged: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        if stream is not None:
            if self.streams.get(stream[0], -1) >= stream[1]:
                return False
            self.streams[stream[0]] = stream[1]
        self.insert(staged)
        return True

    def apply(self, commands: DataFrame) -> None:
        self._keep(transitions.transition(self.read(), commands))

    def poll(self, now, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
        return scans.poll_pending(self.read(), now, limit, skip_recent)

    def claim(self, owner: str, now, lock_expiry, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
        self._keep(scans.claim_marks(self.read(), owner, now, lock_expiry, limit, skip_recent))
        return scans.select_claimed(self.read(), owner, now)

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids, "event_id", "left_semi")

    def query_dead(self, limit: int, event_type: str | None = None, aggregate_type: str | None = None) -> DataFrame:
        return scans.query_dead(self.read(), limit, event_type, aggregate_type)

    def count_dead(self, event_type: str | None = None) -> int:
        return scans.count_dead(self.read(), event_type).first().n_dead

    def replay(self, event_id: str, now) -> bool:
        one = scans.by_id(self.read(), event_id).where(F.col("status") == int(Status.DEAD)).select("event_id").collect()
        if one:
            self._keep(transitions.mark(self.read(), self.spark.createDataFrame(one), "replay", at=now))
        return bool(one)

    def replay_all(self, now, event_type: str | None = None, aggregate_type: str | None = None, batch: int = 100) -> int:
        n = scans.dead(self.read(), event_type, aggregate_type).count()
        self._keep(transitions.replay_all(self.read(), now, event_type, aggregate_type, batch))
        return n

    def purge(self, cutoff, limit: int | None = 500, by_age: bool = False) -> int:
        rule, before = (purge.made_before if by_age else purge.ended_before)(cutoff), len(self.rows)
        self._keep(purge.drain(self.read(), rule) if limit is None else purge.survivors(self.read(), rule, limit))
        return before - len(self.rows)


class RecordingHook(ingest.WriterHook):
    """Notes each call with the ids of its batch."""

    def __init__(self):
        self.calls: list[tuple[str, list[str]]] = []

    def _note(self, what: str, events: DataFrame) -> DataFrame:
        self.calls.append((what, sorted(r.event_id for r in events.select("event_id").collect())))
        return events

    def before_write(self, events: DataFrame) -> DataFrame:
        return self._note("before_write", events)

    def after_write(self, events: DataFrame) -> None:
        self._note("after_write", events)

    def after_commit(self, events: DataFrame) -> None:
        self._note("after_commit", events)

    def after_rollback(self, events: DataFrame) -> None:
        self._note("after_rollback", events)


def memory_stack(spark: SparkSession, config: flows.Config | None = None, **more) -> flows.Stack:
    """A stack on a store in memory, with an exporter that keeps what it gets."""
    return flows.Stack(MemoryStore(spark), config or flows.single_node(), **({"exporter": Recorder()} | more))
