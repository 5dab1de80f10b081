"""The event flow as Structured Streaming: append-only feeds, in-flight tracking, poll cycles, topologies."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from relayloom.functions.headers import CODEC, Codec
from relayloom.operators import dispatch, ingest, metrics, transitions
from relayloom.operators.routing import Routes, route
from relayloom.schema import EVENTS, ORDER, POLLED, instant, pending
from relayloom.sources.store import EventStore
from relayloom.streaming.exporters import OF_ACTION, Exporter


def _millis(now: datetime | str) -> datetime:
    """A clock as polls have it: cut to whole milliseconds."""
    at = datetime.fromisoformat(now) if isinstance(now, str) else now
    return at.replace(microsecond=at.microsecond // 1000 * 1000)


def feed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """An append-only folder of event rows; max_files bounds what a micro-batch takes."""
    reader = spark.readStream.schema(EVENTS)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def deduped(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event_id once; ids are forgotten `lateness` after their time, so state stays bounded."""
    stamped = events.withColumn("__at", F.to_timestamp("created_at"))
    return stamped.withWatermark("__at", lateness).dropDuplicatesWithinWatermark(["event_id"]).drop("__at")


class InFlight(StatefulProcessor):
    """Passes an event if it isn't in flight: unknown, or taken longer than ttl ago (never, if ttl is 0).

    Input rows: event_id, at_ms, op (acquire or release); output: event_id, at_ms of what was acquired."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Twice the ttl after its last use a key is of no more interest; Spark drops it.
        self.taken = handle.getValueState("taken", "at_ms long", 2 * self.ttl_ms if self.ttl_ms > 0 else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        got = []
        for _, r in pd.concat(rows).sort_values("at_ms", kind="stable").iterrows():
            if r["op"] == "release":
                self.taken.clear()
                continue
            held = self.taken.get()
            if held is None or (self.ttl_ms > 0 and r["at_ms"] - held[0] > self.ttl_ms):
                self.taken.update((int(r["at_ms"]),))
                got.append((key[0], int(r["at_ms"])))
        yield pd.DataFrame(got, columns=["event_id", "at_ms"])

    def close(self) -> None: ...


def tracked(requests: DataFrame, ttl_ms: int) -> DataFrame:
    return requests.groupBy("event_id").transformWithStateInPandas(InFlight(ttl_ms), "event_id string, at_ms long", "append", "processingTime" if ttl_ms > 0 else "none")


class Tracker:
    """What is in flight in this process: an id that was acquired is refused until it is released or, if ttl is above 0,
    was taken longer than ttl ago. Ids past twice the ttl are swept out every 1024 acquisitions."""

    def __init__(self, ttl: timedelta = timedelta(0), clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.taken, self.asked, self.lock = ttl.total_seconds(), clock, {}, 0, threading.Lock()

    def acquire(self, event_id: str) -> bool:
        with self.lock:
            now = self.clock()
            self.asked += 1
            if self.ttl > 0 and self.asked % 1024 == 0:
                self.taken = {k: t for k, t in self.taken.items() if now - t <= 2 * self.ttl}
            held = self.taken.get(event_id)
            if held is not None and not (self.ttl > 0 and now - held > self.ttl):
                return False
            self.taken[event_id] = now
            return True

    def release(self, event_id: str) -> None:
        with self.lock:
            self.taken.pop(event_id, None)


class HotQueue:
    """Ids of fresh events that wait for delivery, oldest first; at most `capacity`."""

    def __init__(self, capacity: int):
        self.capacity, self.ids, self.closed, self.lock = capacity, [], False, threading.Lock()

    def offer(self, ids: Iterable[str]) -> int:
        """How many were taken; the others are found by a poll."""
        with self.lock:
            if self.closed:
                return 0
            new = list(ids)[: max(self.capacity - len(self.ids), 0)]
            self.ids += new
            return len(new)

    def take(self, most: int) -> list[str]:
        with self.lock:
            out, self.ids = self.ids[:most], self.ids[most:]
            return out

    def close(self) -> None:
        """Take nothing more."""
        with self.lock:
            self.closed = True

    def __len__(self) -> int:
        return len(self.ids)


@dataclass
class Config:
    """One stack: a table, its routes and how it is worked off. With `hot`, what is written is queued for delivery at once,
    and polls find what that queue had no room for."""

    hot: bool = True
    mode: str | None = "poll"  # poll, claim, or None for a table that others read
    max_attempts: int = 10
    workers: int = 4
    interval: timedelta = timedelta(seconds=5)
    batch: int = 50
    capacity: int = 1000
    hot_capacity: int = 1000
    skip_recent: timedelta | None = None
    owner: str | None = None
    lock_timeout: timedelta = timedelta(minutes=5)
    retention: timedelta | None = None
    purge_by_age: bool = False
    purge_batch: int = 500
    in_flight_ttl: timedelta = timedelta(0)
    #: Milliseconds until the next attempt, from the number of attempts: a column of a column.
    retry: Callable[[Column], Column] = dispatch.backoff

    def __post_init__(self):
        if self.mode not in ("poll", "claim", None):
            raise ValueError(f"no such mode: {self.mode}")
        if self.mode == "claim" and not self.owner:
            raise ValueError("claims need an owner")
        if self.max_attempts < 1 or self.batch < 1 or self.workers < 1:
            raise ValueError("attempts, batch and workers are at least 1")


def single_node(**more) -> Config:
    return Config(**more)


def multi_node(owner: str, **more) -> Config:
    return Config(mode="claim", owner=owner, **more)


def ordered(**more) -> Config:
    """One worker, in the order of the table, without retries: a retry would come after later events."""
    return Config(hot=False, workers=1, max_attempts=1, **more)


def writer_only(retention: timedelta | None = None) -> Config:
    """Rows are read by an external feed; only age decides what is purged."""
    return Config(hot=False, mode=None, retention=retention, purge_by_age=True)


_UNITS = {"ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}


def _duration(text: str) -> timedelta:
    number = text.rstrip("smhd")
    return timedelta(seconds=float(number) * _UNITS[text[len(number) :] or "ms"])


def from_properties(properties: dict[str, str]) -> Config:
    """A configuration from text settings: mode (single-node, multi-node, ordered, writer-only), and any
    field of Config in lower-case words joined by hyphens; durations as 500ms, 5s, 3m, 2h or 7d."""
    rest = dict(properties)
    make = {"single-node": single_node, "multi-node": multi_node, "ordered": ordered, "writer-only": writer_only}
    mode = rest.pop("mode", "single-node")
    if mode not in make:
        raise ValueError(f"no such mode: {mode}")
    given = {}
    for name, text in rest.items():
        name = name.replace("-", "_")
        default = Config.__dataclass_fields__.get(name)
        if default is None or name in ("hot", "mode", "retry"):
            raise ValueError(f"no such setting: {name}")
        kind = str(default.type)
        given[name] = _duration(text) if "timedelta" in kind else int(text) if kind == "int" else text == "true" if kind == "bool" else text
    try:
        return make[mode](**given)
    except TypeError as e:
        raise ValueError(f"not a setting of {mode}: {e}") from e


class PollHandler:
    """Takes what a poll finds. `capacity` may bound a poll (None: no bound); `handle` gives the number of events that it took."""

    def capacity(self) -> int | None:
        return None

    def handle(self, polled: DataFrame, now) -> int:
        raise NotImplementedError


@dataclass
class Stack(PollHandler):
    """A store with its configuration; stacks of several databases stand side by side."""

    store: EventStore
    config: Config
    routes: Routes = field(default_factory=Routes)
    handlers: dict[str, Callable] = field(default_factory=dict)
    interceptors: list[dispatch.Interceptor] = field(default_factory=list)
    hooks: list[ingest.WriterHook] = field(default_factory=list)
    exporter: Exporter = field(default_factory=Exporter)
    tracker: Tracker | None = None
    codec: Codec = CODEC

    def __post_init__(self):
        self.tracker = self.tracker or Tracker(self.config.in_flight_ttl if self.config else timedelta(0))
        self.hot = HotQueue(self.config.hot_capacity if self.config else 0)

    def listener(self, event_type: object, aggregate_type: object = "__GLOBAL__"):
        """Decorator: register a function as the listener of a pair."""

        def keep(f: Callable) -> Callable:
            self.routes.add(f.__qualname__, event_type, aggregate_type)
            self.handlers[f.__qualname__] = f
            return f

        return keep

    def write(self, envelopes: DataFrame, now, stream: tuple[str, int] | None = None) -> DataFrame:
        """Validated rows through the hooks into the store; an invalid envelope fails the batch. After the commit, with `hot`, they are
        queued for delivery. With a stream's name and batch number, a batch that was written before is left out."""
        bad = ingest.validate(envelopes, now).where("error is not null")
        if not bad.isEmpty():
            raise ValueError(f"invalid envelope: {bad.first().error}")
        staged, layer = self.store.stage(ingest.normalize(envelopes, now, self.codec))
        written, new = [], [True]

        def sink(events: DataFrame) -> None:
            rows, own = (staged, layer) if events is staged else self.store.stage(events)
            new[0] = self.store.commit(own, stream)
            written.append(rows)

        ids = ingest.write(staged, sink, self.hooks)
        if written and new[0] and self.config.hot:
            self._queue(written[0])
        return ids

    def _queue(self, written: DataFrame) -> None:
        """Put fresh events into the hot queue: their ids, as many as it has room for."""
        fates = dispatch.hot_split(written, self.hot.capacity - len(self.hot))
        taken = fates.where("fate = 'accepted'").orderBy("created_at", "event_id").select("event_id").collect()
        n = self.hot.offer(r.event_id for r in taken)
        count = {r.fate: r["count"] for r in fates.groupBy("fate").count().collect()}
        self.exporter.add("hot_enqueued", n)
        self.exporter.add("hot_dropped", count.get("dropped", 0) + len(taken) - n)
        self.exporter.add("hot_delayed", count.get("delayed", 0))
        self.exporter.queue_depth(dispatch.HOT, len(self.hot))

    def cycle(self, now: datetime | str, capacity: int | None = None) -> int:
        """Deliver what waits in the hot queue and one batch of a poll or claim, two to one; apply what came of it; the number of
        events delivered."""
        return self.poll(now, self, self.config.capacity if capacity is None else capacity)

    def poll(self, now: datetime | str, handler: PollHandler, capacity: int | None = None) -> int:
        """Hand one batch of due events, by poll or claim, to a handler; the number that it took."""
        c, now = self.config, _millis(now)
        room = min([c.batch] + [x for x in (capacity, handler.capacity()) if x is not None])
        if c.mode is None or (room <= 0 and handler is not self):
            return 0
        if room <= 0:  # nothing of the table, but what waits in the hot queue
            polled = self.store.spark.createDataFrame([], T.StructType([EVENTS[n] for n in POLLED]))
        elif c.mode == "claim":
            polled = self.store.claim(c.owner, now, now - c.lock_timeout, room, c.skip_recent)
        else:
            polled = self.store.poll(now, room, c.skip_recent)
        # The batch, bounded by `room`, is read once: what follows must not find other rows.
        polled = self.store.spark.createDataFrame(polled.select(*POLLED).collect(), polled.select(*POLLED).schema)
        self.exporter.oldest_lag_ms(metrics.oldest_lag(polled, now).first().oldest_lag_ms)
        return handler.handle(polled, now)

    def handle(self, polled: DataFrame, now: datetime) -> int:
        """Deliver polled events, and those that wait in the hot queue."""
        spark, most = self.store.spark, self.config.batch
        ids = self.hot.take(most)
        hot = self.store.by_ids(spark.createDataFrame([(i,) for i in ids], "event_id string")).where(pending()).orderBy(*ORDER).select(*POLLED) if ids else polled.limit(0)
        rows = hot.collect(), polled.collect()  # at most a batch each
        schema = T.StructType([*polled.schema.fields, T.StructField("rank", T.LongType())])
        queues = [spark.createDataFrame([(*r, k) for k, r in enumerate(some)], schema) for some in rows]
        self.exporter.add("cold_enqueued", len(rows[1]))
        self.exporter.queue_depth(dispatch.COLD, len(rows[1]))
        self.exporter.queue_depth(dispatch.HOT, len(self.hot))
        return self._deliver(dispatch.inflight_dedupe(dispatch.fair_merge(*queues)).orderBy("position"), now)

    def _deliver(self, queue: DataFrame, now: datetime) -> int:
        c, spark = self.config, self.store.spark
        rows = [r for r in queue.collect() if self.tracker.acquire(r.event_id)]  # bounded by the batch of each queue
        if not rows:
            return 0
        try:
            decoded = dispatch.decode(spark.createDataFrame(rows, queue.schema), self.codec)
            routed = route(decoded, self.routes.frame(spark)).orderBy("position")
            sound = dispatch.handle(routed.where("decode_error is null").coalesce(c.workers), self.handlers, self.interceptors)
            at = instant(now)
            broken = decoded.where("decode_error is not null").select("event_id", F.lit(0).cast("long").alias("seq"), F.lit("dead").alias("action"), at.alias("at"), F.lit(None).cast("timestamp_ntz").alias("next_at"), F.col("decode_error").alias("error"), F.lit(None).cast("double").alias("listener_ms"))
            ended = dispatch.outcomes(sound, now, c.max_attempts, c.retry(F.col("attempts") + 1), "listener_ms").unionByName(broken)
            # Handlers have effects, so what they answered is fixed before it is used.
            answers = ended.collect()
            commands = spark.createDataFrame([r[:6] for r in answers], transitions.COMMANDS)
            self.store.apply(commands)
        finally:
            for r in rows:
                self.tracker.release(r.event_id)
        ends = Counter(r.action for r in answers)
        for action, count in ends.items():
            self.exporter.add(OF_ACTION[action], count)
        made = {r.event_id: r.created_at for r in rows}
        waits = [int((now - made[r.event_id]) / timedelta(milliseconds=1)) for r in answers if r.action == "done"]
        waits = [w for w in waits if w >= 0]
        self.exporter.latency_ms(len(waits), sum(waits), max(waits, default=None))
        took = [r.listener_ms for r in answers if r.listener_ms is not None]
        self.exporter.listener_ms(len(took), sum(took), max(took, default=None))
        return len(answers)

    def purge(self, now: datetime) -> int:
        if self.config.retention is None:
            return 0
        return self.store.purge(now - self.config.retention, None, self.config.purge_by_age)

    def start_purge(self, checkpoint: str, every: timedelta = timedelta(hours=1), clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> StreamingQuery:
        """Purges at an interval, the first time after one interval has passed."""
        begun = clock()
        ticks = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def run(_, __):
            now = clock()
            if now - begun >= every:
                self.purge(now)

        return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every.total_seconds()} seconds").start()

    def drain(self, now, most: int | None = None) -> int:
        """Cycles until nothing is due; after `most` cycles, if given, events that are still delivered are an error. (A
        handler that defers by nothing makes its event due again, without end.)"""
        total = cycles = 0
        while n := self.cycle(now):
            total, cycles = total + n, cycles + 1
            if most is not None and cycles > most:
                raise RuntimeError(f"events are still due after {most} cycles")
        return total

    def close(self, now: datetime | str, timeout: timedelta = timedelta(seconds=5)) -> int:
        """Queue no more fresh events, deliver those that wait until the time is up, and leave the rest to a poll; how many were delivered."""
        self.hot.close()
        n, end = 0, time.monotonic() + timeout.total_seconds()
        while len(self.hot) and time.monotonic() < end:
            n += self.poll(now, self, 0)
        self.hot.take(len(self.hot))
        self.exporter.close()
        return n

    def start(self, checkpoint: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> StreamingQuery:
        """Cycles at the configured interval, driven by a rate source; stop() ends after the running one."""
        ticks = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        run = lambda _, __: self.cycle(clock())
        return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{self.config.interval.total_seconds()} seconds").start()


def ingest_stream(envelopes: DataFrame, stack: Stack, checkpoint: str, now: Callable[[], datetime], once: bool = True) -> StreamingQuery:
    """Write a stream of envelopes to the stack's store, a micro-batch at a time; one batch writes once even if it is run again,
    as the store's commits name the last batch of each stream (known by its checkpoint folder)."""

    def put(batch: DataFrame, number: int) -> None:
        stack.write(batch, now(), (checkpoint, number))

    writer = envelopes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stop_all(queries: Iterable[StreamingQuery]) -> None:
    """Stop every query even if one fails; the first failure is raised at the end, with the others as notes."""
    first: Exception | None = None
    for q in queries:
        try:
            q.stop()
        except Exception as e:
            if first is None:
                first = e
            else:
                first.add_note(f"also: {e}")
    if first is not None:
        raise first
