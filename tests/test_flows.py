import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relayloom.functions.headers import Codec
from relayloom.operators import dispatch, ingest
from relayloom.schema import ENVELOPES, EVENTS
from relayloom.sources import jdbc
from relayloom.sources.store import Conflict, EventStore
from relayloom.streaming import flows
from relayloom.streaming.exporters import ProgressListener, Recorder, observed

T0 = datetime(2024, 1, 10, 12)


def envelopes(spark, n, **more):
    base = {c: None for c in ENVELOPES.names}
    rows = [tuple((base | {"event_id": f"e{k:03d}", "event_type": "made", "payload_json": "{}", "occurred_at": T0 + timedelta(seconds=k)} | more).values()) for k in range(n)]
    return spark.createDataFrame(rows, ENVELOPES)


def stack(spark, path, config, **more):
    return flows.Stack(EventStore(spark, str(path)), config, **more)


def statuses(s):
    return {r.event_id: (r.status, r.attempts) for r in s.store.read().collect()}


def test_one_node_delivers_all(spark, tmp_path):
    s = stack(spark, tmp_path, flows.single_node(batch=4))
    s.listener("made")(lambda e: None)
    assert s.write(envelopes(spark, 10), T0).count() == 10
    assert s.drain(T0 + timedelta(minutes=1)) == 10
    assert set(statuses(s).values()) == {(1, 0)} and s.cycle(T0 + timedelta(minutes=1)) == 0


def test_made_ids_are_those_that_are_stored(spark, tmp_path):
    s = stack(spark, tmp_path, flows.single_node())
    made = s.write(envelopes(spark, 5, event_id=None), T0)
    assert {r.event_id for r in made.collect()} == {r.event_id for r in s.store.read().collect()} and made.count() == 5


def test_failures_retry_and_die(spark, tmp_path):
    s = stack(spark, tmp_path, flows.single_node(max_attempts=3))
    s.listener("made")(lambda e: 1 / 0)
    s.write(envelopes(spark, 1), T0)
    now = T0
    for want in ((2, 1), (2, 2), (3, 2)):
        now += timedelta(minutes=5)
        s.cycle(now)
        assert statuses(s)["e000"] == want
    assert "ZeroDivisionError" in s.store.read().first().last_error
    assert s.store.count_dead() == 1 and s.store.replay("e000", now) and not s.store.replay("e000", now)
    assert statuses(s)["e000"] == (0, 0) and s.store.replay_all(now) == 0


def test_ordered_mode_fails_at_once(spark, tmp_path):
    s = stack(spark, tmp_path, flows.ordered())
    s.listener("made")(lambda e: 1 / 0)
    s.write(envelopes(spark, 2), T0)
    s.cycle(T0 + timedelta(minutes=1))
    assert set(statuses(s).values()) == {(3, 0)}


def test_claims_of_two_nodes_are_disjoint(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.insert(ingest.normalize(envelopes(spark, 3), T0))
    now = T0 + timedelta(minutes=1)
    a = {r.event_id for r in store.claim("a", now, now - timedelta(minutes=5), 2).collect()}
    b = {r.event_id for r in store.claim("b", now, now - timedelta(minutes=5), 5).collect()}
    assert a == {"e000", "e001"} and b == {"e002"}
    s = flows.Stack(store, flows.multi_node("c", lock_timeout=timedelta(seconds=30)))
    s.listener("made")(lambda e: None)
    assert s.cycle(now) == 0 and s.cycle(now + timedelta(minutes=1)) == 3


def test_unroutable_and_undecodable_die(spark, tmp_path):
    s = stack(spark, tmp_path, flows.single_node())
    s.listener("made")(lambda e: None)
    base = {n: None for n in EVENTS.names} | {"event_type": "made", "payload": "{}", "status": 0, "attempts": 0, "available_at": T0, "created_at": T0}
    rows = [base | {"event_id": "a"}, base | {"event_id": "b", "event_type": "other"}, base | {"event_id": "c", "headers": "not-json"}]
    s.store.insert(spark.createDataFrame([tuple(r.values()) for r in ({n: x[n] for n in EVENTS.names} for x in rows)], EVENTS))
    assert s.cycle(T0) == 3
    got = {r.event_id: (r.status, r.last_error) for r in s.store.read().collect()}
    assert got["a"] == (1, None) and got["b"][0] == got["c"][0] == 3 and "headers" in got["c"][1]


def test_capacity_hooks_and_purge(spark, tmp_path):
    said = []

    class Hook(ingest.WriterHook):
        def before_write(self, events):
            return events.where("event_id <> 'e001'")

        def after_commit(self, events):
            said.append(events.count())

    s = stack(spark, tmp_path, flows.single_node(hot=False, retention=timedelta(days=7)), hooks=[Hook()])
    s.listener("made")(lambda e: dispatch.Result(60_000) if e["event_id"] == "e002" else None)
    assert s.write(envelopes(spark, 3), T0).count() == 2 and said == [2]
    now = T0 + timedelta(minutes=1)
    assert s.cycle(now, capacity=0) == 0 and s.cycle(now, capacity=1) == 1 and s.cycle(now) == 1
    assert statuses(s) == {"e000": (1, 0), "e002": (2, 0)}
    assert s.purge(now + timedelta(days=7)) == 0
    assert s.purge(now + timedelta(days=7, seconds=1)) == 1
    s.store.compact()
    s.store.vacuum(1)
    assert statuses(s) == {"e002": (2, 0)}

    class No(ingest.WriterHook):
        def before_write(self, events):
            return None

    assert ingest.write(envelopes(spark, 1), lambda e: 1 / 0, [No()]).count() == 0
    with pytest.raises(ValueError, match="event_type_empty"):
        s.write(envelopes(spark, 1, event_type=""), T0)


def test_streams(spark, tmp_path):
    s = stack(spark, tmp_path / "t", flows.single_node())
    envelopes(spark, 6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ENVELOPES).parquet(str(tmp_path / "in"))
    flows.ingest_stream(stream, s, str(tmp_path / "cp"), lambda: T0).awaitTermination(120)
    assert len(statuses(s)) == 6
    s.store.read().unionAll(s.store.read()).write.parquet(str(tmp_path / "feed"))
    q = flows.deduped(flows.feed(spark, str(tmp_path / "feed"), 1)).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("deduped")
    assert got.count() == got.select("event_id").distinct().count() == 6


def test_in_flight_tracking(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", 0, "acquire"), ("a", 5, "acquire"), ("a", 10, "acquire"), ("a", 11, "acquire"), ("b", 0, "acquire"), ("b", 1, "release"), ("b", 2, "acquire")]
    spark.createDataFrame(rows, "event_id string, at_ms long, op string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id string, at_ms long, op string").parquet(str(tmp_path / "in"))
    q = flows.tracked(stream, 10).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tracked").collect())) == [("a", 0), ("a", 11), ("b", 0), ("b", 2)]


def test_configurations():
    with pytest.raises(ValueError):
        flows.Config(mode="claim")
    with pytest.raises(ValueError):
        flows.Config(batch=0)
    assert flows.ordered().max_attempts == 1 and flows.writer_only(timedelta(days=1)).purge_by_age


def test_properties():
    c = flows.from_properties({"mode": "multi-node", "owner": "n1", "batch": "7", "lock-timeout": "90s", "interval": "250ms", "retention": "7d", "purge-by-age": "true"})
    assert (c.mode, c.owner, c.batch, c.lock_timeout, c.interval, c.retention, c.purge_by_age) == ("claim", "n1", 7, timedelta(seconds=90), timedelta(milliseconds=250), timedelta(days=7), True)
    assert flows.from_properties({}) == flows.single_node() and flows.from_properties({"mode": "ordered"}).workers == 1
    for bad in ({"mode": "x"}, {"colour": "red"}, {"mode": "writer-only", "batch": "3"}, {"hot": "true"}):
        with pytest.raises(ValueError):
            flows.from_properties(bad)


def test_exporter(spark, tmp_path):
    s = stack(spark, tmp_path / "t", flows.single_node(), exporter=Recorder())
    s.listener("made")(lambda e: 1 / 0 if e["event_id"] == "e001" else None)
    s.write(envelopes(spark, 3), T0)
    s.cycle(T0 + timedelta(minutes=1))
    assert {k: v for k, v in s.exporter.counters.items() if v} == {"hot_enqueued": 3, "cold_enqueued": 3, "dispatch_success": 2, "dispatch_failure": 1}
    assert s.exporter.depths == {"HOT": 0, "COLD": 3} and s.exporter.lag == 60_000
    (count, total, largest), (handled, took, _) = s.exporter.latencies[-1], s.exporter.durations[-1]
    assert (count, total, largest) == (2, 60_000 + 58_000, 60_000) and handled == 2 and took > 0
    listener = ProgressListener(Recorder())
    spark.streams.addListener(listener)
    spark.createDataFrame([("done",), ("dead",), ("done",)], "action string").write.parquet(str(tmp_path / "in"))
    q = observed(spark.readStream.schema("action string").parquet(str(tmp_path / "in"))).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(50):
        if listener.exporter.counters["dispatch_success"]:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert (listener.exporter.counters["dispatch_success"], listener.exporter.counters["dispatch_dead"]) == (2, 1)


def test_dialects():
    assert jdbc.dialect_of("JDBC:MySQL://x").name == jdbc.dialect_of("jdbc:tidb://x").name == "mysql"
    assert jdbc.dialect("PostgreSQL").insert("t").count("jsonb") == 2 and jdbc.dialect("h2").insert("t", 2).count("?") == 30
    assert "RETURNING" in jdbc.dialect("postgresql").claim("t")[0] and len(jdbc.dialect("mysql").claim("t")) == 2
    assert jdbc.dialect("mysql").purge("t").endswith("LIMIT ?") and "IN (SELECT" in jdbc.dialect("h2").purge("t", True)
    for bad in (lambda: jdbc.dialect_of("jdbc:x:"), lambda: jdbc.dialect("x"), lambda: jdbc.dialect("h2").insert("a;b")):
        with pytest.raises(ValueError):
            bad()


def test_stop_all_raises_the_first_failure():
    class Q:
        def __init__(self, e=None):
            self.e, self.stopped = e, False

        def stop(self):
            self.stopped = True
            if self.e:
                raise self.e

    qs = [Q(), Q(ValueError("a")), Q(ValueError("b")), Q()]
    with pytest.raises(ValueError, match="a"):
        flows.stop_all(qs)
    assert all(q.stopped for q in qs)


def test_column_is_a_clock(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    store.insert(ingest.normalize(envelopes(spark, 1), T0))
    assert store.poll(F.lit(T0).cast("timestamp_ntz"), 1).count() == 1


def test_drain_has_no_silent_end(monkeypatch):
    from relayloom.streaming.flows import Stack

    left = [50] * 1200
    monkeypatch.setattr(Stack, "cycle", lambda self, now: left.pop() if left else 0)
    stack = Stack(None, None)
    assert stack.drain(T0) == 60_000
    left[:] = [50] * 4
    with pytest.raises(RuntimeError):
        stack.drain(T0, 3)
    left[:] = [50] * 3
    assert stack.drain(T0, 3) == 150


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_a_cycle_writes_what_its_batch_needs(spark, tmp_path):
    big = envelopes(spark, 1).crossJoin(spark.range(20_000)).withColumn("event_id", F.format_string("x%06d", "id")).drop("id")
    s = stack(spark, tmp_path, flows.single_node(hot=False, batch=20))
    s.listener("made")(lambda e: None)
    s.write(big.withColumn("payload_json", F.repeat(F.sha2("event_id", 256), 4)), T0)
    whole = size(tmp_path)
    for _ in range(3):
        assert s.cycle(T0 + timedelta(minutes=1)) == 20
    assert size(tmp_path) - whole < 3 * 20_000 < whole / 20
    assert s.store.read().where("status = 1").count() == 60 and s.store.read().count() == 20_000
    plan = s.store.poll(T0 + timedelta(minutes=1), 20)._jdf.queryExecution().executedPlan().toString()
    assert "In(status, [0,2])" in plan or "PartitionFilters: [status" in plan


def test_layers_are_merged(spark, tmp_path, monkeypatch):
    from relayloom.sources import store as stores

    monkeypatch.setattr(stores, "LAYERS", 3)
    s = stack(spark, tmp_path, flows.single_node(hot=False, batch=1))
    s.listener("made")(lambda e: None)
    for k in range(6):
        s.write(envelopes(spark, 1, event_id=f"w{k}"), T0 + timedelta(seconds=k))
    for _ in range(5):
        assert s.cycle(T0 + timedelta(minutes=1)) == 1
    state = s.store.state()
    assert len(state["rows"]) <= 4 and len(state["changes"]) <= 4
    assert sorted(statuses(s).values()) == [(0, 0)] + 5 * [(1, 0)]
    monkeypatch.setattr(stores, "LEAST", 0)
    s.cycle(T0 + timedelta(minutes=1))
    state = s.store.state()
    assert len(state["rows"]) == 1 and not state["changes"]
    s.store.vacuum(1)
    assert set(statuses(s).values()) == {(1, 0)} and len(statuses(s)) == 6


def test_two_writers_at_once(spark, tmp_path):
    """Each of four threads claims until nothing is left: every event has one owner."""
    first = EventStore(spark, str(tmp_path))
    first.insert(ingest.normalize(envelopes(spark, 24), T0))
    got, now = {}, T0 + timedelta(minutes=1)

    def work(owner):
        own, k = EventStore(spark, str(tmp_path)), 0
        while rows := own.claim(owner, now + timedelta(milliseconds=k), T0, 5).collect():
            got.setdefault(owner, []).extend(r.event_id for r in rows)
            k += 1

    threads = [threading.Thread(target=work, args=(f"n{k}",)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    claimed = [i for ids in got.values() for i in ids]
    assert len(claimed) == len(set(claimed)) == 24
    assert {r.event_id: r.locked_by for r in first.read().collect()} == {i: owner for owner, ids in got.items() for i in ids}


def test_one_of_two_commits_of_a_number_fails(spark, tmp_path):
    store = EventStore(spark, str(tmp_path))
    before = store.state()
    store._publish(before)
    with pytest.raises(Conflict):
        store._publish(before)
    assert store.state()["number"] == 0


def test_a_stream_batch_is_written_once(spark, tmp_path):
    s = stack(spark, tmp_path, flows.single_node())
    for number in (0, 0, 1, 1):
        s.write(envelopes(spark, 2, event_id=None), T0, ("in", number))
    assert s.store.read().count() == 4 and len(s.hot) == 4


def test_hot_path(spark, tmp_path):
    """What is written is delivered without a poll; what finds no room waits for one, and what is for later is left alone."""
    s = stack(spark, tmp_path / "a", flows.single_node(hot_capacity=3), exporter=Recorder())
    s.listener("made")(lambda e: None)
    s.write(envelopes(spark, 5), T0)
    s.write(envelopes(spark, 1, event_id="late", deliver_after_ms=60_000), T0)
    assert s.hot.ids == ["e000", "e001", "e002"]
    assert [s.exporter.counters[c] for c in ("hot_enqueued", "hot_dropped", "hot_delayed")] == [3, 2, 1]
    assert s.cycle(T0, capacity=0) == 3 and not len(s.hot)
    assert {i for i, x in statuses(s).items() if x == (1, 0)} == {"e000", "e001", "e002"}
    assert s.exporter.counters["cold_enqueued"] == 0
    assert s.drain(T0 + timedelta(minutes=2)) == 3
    cold = stack(spark, tmp_path / "b", flows.single_node(hot=False), exporter=Recorder())
    cold.write(envelopes(spark, 5), T0)
    assert not len(cold.hot) and cold.exporter.counters["hot_enqueued"] == 0 and cold.cycle(T0, capacity=0) == 0


def test_an_event_in_both_queues_is_delivered_once(spark, tmp_path):
    said = tmp_path / "said"
    s = stack(spark, tmp_path / "t", flows.single_node())

    @s.listener("made")
    def note(e):
        with open(said, "a") as f:
            f.write(e["event_id"] + "\n")

    s.write(envelopes(spark, 4), T0)
    assert s.cycle(T0 + timedelta(minutes=1)) == 4
    assert sorted(said.read_text().split()) == ["e000", "e001", "e002", "e003"]


def test_what_is_in_flight_is_left_to_its_deliverer(spark, tmp_path):
    tracker = flows.Tracker()
    s = stack(spark, tmp_path, flows.single_node(hot=False), tracker=tracker)
    s.listener("made")(lambda e: None)
    s.write(envelopes(spark, 2), T0)
    assert tracker.acquire("e000") and s.cycle(T0 + timedelta(minutes=1)) == 1
    tracker.release("e000")
    assert s.cycle(T0 + timedelta(minutes=1)) == 1 and not tracker.taken


def test_tracker():
    at = [0.0]
    t = flows.Tracker(timedelta(seconds=10), lambda: at[0])
    assert t.acquire("a") and not t.acquire("a") and t.acquire("b")
    at[0] = 10.0
    assert not t.acquire("a")
    at[0] = 10.1
    assert t.acquire("a")
    t.release("a")
    assert t.acquire("a")
    at[0] = 40.0
    for k in range(1024):
        t.acquire(f"x{k}")
    assert "b" not in t.taken
    never = flows.Tracker(timedelta(0), lambda: at[0])
    assert never.acquire("a")
    at[0] = 1e9
    assert not never.acquire("a")


def test_claims_may_skip_recent_events(spark, tmp_path):
    s = stack(spark, tmp_path, flows.multi_node("n", hot=False, skip_recent=timedelta(seconds=30)))
    s.listener("made")(lambda e: None)
    s.write(envelopes(spark, 3), T0)
    assert s.cycle(T0 + timedelta(seconds=31)) == 2 and s.cycle(T0 + timedelta(seconds=32)) == 1


def test_a_failing_hook_is_tried_again_even_without_a_listener(spark, tmp_path):
    s = stack(spark, tmp_path, flows.single_node(hot=False), interceptors=[dispatch.Interceptor(lambda e: 1 / 0 if e["event_id"] == "e000" else None)])
    s.write(envelopes(spark, 2), T0)
    s.cycle(T0 + timedelta(minutes=1))
    assert statuses(s) == {"e000": (2, 1), "e001": (3, 0)}


def test_retry_policies(spark, tmp_path):
    now = T0 + timedelta(minutes=1)
    for name, config, low, high in (("own", flows.single_node(retry=lambda n: n * 7000), 7000, 7000), ("jitter", flows.single_node(), 100, 300)):
        s = stack(spark, tmp_path / name, config)
        s.listener("made")(lambda e: 1 / 0)
        s.write(envelopes(spark, 20), T0)
        s.cycle(now)
        waits = [(r.available_at - now) / timedelta(milliseconds=1) for r in s.store.read().collect()]
        assert low <= min(waits) and max(waits) <= high
        assert name == "own" or len(set(waits)) > 5


def test_another_handler_may_take_what_a_poll_finds(spark, tmp_path):
    class Two(flows.PollHandler):
        seen = []

        def capacity(self):
            return 2 - len(self.seen)

        def handle(self, polled, now):
            self.seen += [r.event_id for r in polled.collect()]
            return polled.count()

    s, taker = stack(spark, tmp_path, flows.single_node(hot=False)), Two()
    s.write(envelopes(spark, 3), T0)
    assert s.poll(T0 + timedelta(minutes=1), taker) == 2 and taker.seen == ["e000", "e001"]
    assert s.poll(T0 + timedelta(minutes=1), taker) == 0


def test_another_codec(spark, tmp_path):
    pairs = Codec(lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), lambda t: F.struct(F.str_to_map(t, F.lit(";"), F.lit("=")).alias("headers"), F.lit(None).cast("string").alias("error")))
    seen = tmp_path / "seen"
    s = stack(spark, tmp_path / "t", flows.single_node(), codec=pairs)

    @s.listener("made")
    def note(e):
        seen.write_text(str(dict(e["header_map"])))

    s.write(envelopes(spark, 1, headers={"a": "b"}), T0)
    assert s.store.read().first().headers == "a=b"
    assert s.cycle(T0 + timedelta(minutes=1)) == 1 and seen.read_text() == "{'a': 'b'}"


def test_closing_delivers_what_waits_until_the_time_is_up(spark, tmp_path):
    for timeout, want in ((60, 5), (0, 0)):
        s = stack(spark, tmp_path / str(timeout), flows.single_node(batch=2))
        s.listener("made")(lambda e: None)
        s.write(envelopes(spark, 5), T0)
        assert s.close(T0 + timedelta(minutes=1), timedelta(seconds=timeout)) == want and not len(s.hot)
        s.write(envelopes(spark, 1, event_id="later"), T0)
        assert not len(s.hot) and s.drain(T0 + timedelta(minutes=1)) == 6 - want
