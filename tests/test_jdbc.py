"""The store in a database that Spark brings along (Derby, in memory)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relayloom.operators import dispatch, ingest, scans, transitions
from relayloom.schema import ENVELOPES
from relayloom.sources import jdbc
from relayloom.sources.jdbc import JdbcStore
from relayloom.sources.store import EventStore
from relayloom.streaming import flows
from relayloom.testing import MemoryStore

T0 = datetime(2024, 1, 10, 12)
S = timedelta(seconds=1)


def envelopes(spark, n, **more):
    base = {c: None for c in ENVELOPES.names}
    rows = [tuple((base | {"event_id": f"e{k:03d}", "event_type": "made", "payload_json": "{}", "occurred_at": T0 + k * S, "headers": {"k": "v"}} | more).values()) for k in range(n)]
    return spark.createDataFrame(rows, ENVELOPES)


@pytest.fixture(params=["derby", "files", "memory"])
def store(spark, tmp_path, request):
    if request.param == "derby":
        made = JdbcStore(spark, f"jdbc:derby:memory:{tmp_path.name};create=true")
        made.create()
        return made
    return EventStore(spark, str(tmp_path)) if request.param == "files" else MemoryStore(spark)


def states(store):
    return {r.event_id: (r.status, r.attempts) for r in store.read().collect()}


def test_rows_come_back(spark, store):
    rows = ingest.normalize(envelopes(spark, 4), T0).checkpoint()
    store.insert(rows)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.collect()))
    assert [r.event_id for r in store.poll(T0 + 2 * S, 2).collect()] == ["e000", "e001"]
    assert [r.event_id for r in store.poll(T0 + 2 * S, 9, S).collect()] == ["e000", "e001"]
    polled = store.poll(T0 + 9 * S, 9)
    assert polled.columns == scans.POLLED and polled.count() == 4
    assert {r.event_id for r in store.by_ids(spark.createDataFrame([("e001",), ("no",)], "event_id string")).collect()} == {"e001"}


def test_commands_and_dead_events(spark, store):
    store.insert(ingest.normalize(envelopes(spark, 6), T0))
    now, later = T0 + 60 * S, T0 + 90 * S
    rows = [("e000", 0, "done", now, None, None), ("e000", 1, "dead", now, None, "late"), ("e001", 0, "retry", now, later, "x" * 5000), ("e002", 0, "defer", now, later, None), ("e003", 0, "dead", now, None, "bad"), ("e004", 0, "dead", now, None, "bad"), ("gone", 0, "done", now, None, None)]
    store.apply(spark.createDataFrame(rows, transitions.COMMANDS))
    assert states(store) == {"e000": (1, 0), "e001": (2, 1), "e002": (2, 0), "e003": (3, 0), "e004": (3, 0), "e005": (0, 0)}
    made = {r.event_id: r for r in store.read().collect()}
    assert made["e000"].done_at == now and made["e001"].available_at == later and len(made["e001"].last_error) == 4000
    assert store.count_dead() == store.count_dead("made") == 2 and store.count_dead("other") == 0
    assert [r.event_id for r in store.query_dead(1).collect()] == ["e003"]
    assert store.query_dead(9, "made", "__GLOBAL__").count() == 2 and store.query_dead(9, None, "User").count() == 0
    assert store.replay("e003", now) and not store.replay("e003", now) and not store.replay("e005", now)
    assert store.replay_all(now, batch=1) == 1 and store.count_dead() == 0


def test_claims_are_disjoint(spark, store):
    store.insert(ingest.normalize(envelopes(spark, 3), T0))
    now = T0 + 60 * S
    a = [r.event_id for r in store.claim("a", now, now - 300 * S, 2).collect()]
    b = [r.event_id for r in store.claim("b", now + S, now - 300 * S, 5).collect()]
    assert (a, b) == (["e000", "e001"], ["e002"])
    assert store.claim("c", now + 2 * S, now, 5).count() == 0
    assert store.claim("c", now + 3 * S, now + S, 5, S).count() == 2


def test_purges(spark, store):
    store.insert(ingest.normalize(envelopes(spark, 5), T0))
    store.apply(spark.createDataFrame([(f"e00{k}", 0, "done", T0 + k * S, None, None) for k in range(4)], transitions.COMMANDS))
    assert store.purge(T0 + 3 * S, 2) == 2 and store.purge(T0 + 3 * S, 2) == 1 and store.purge(T0 + 3 * S, 2) == 0
    assert set(states(store)) == {"e003", "e004"}
    assert store.purge(T0 + 9 * S, None, by_age=True) == 2 and not states(store)


def test_stack_on_any_store(spark, store):
    s = flows.Stack(store, flows.multi_node("n1", max_attempts=2))
    s.listener("made")(lambda e: 1 / 0 if e["event_id"] == "e001" else dispatch.Result(60_000) if e["event_id"] == "e002" else None)
    s.write(envelopes(spark, 4), T0)
    assert s.cycle(T0 + 60 * S) == 4 and states(store) == {"e000": (1, 0), "e001": (2, 1), "e002": (2, 0), "e003": (1, 0)}
    assert s.cycle(T0 + 90 * S) == 1 and states(store)["e001"] == (3, 1)


def test_transactions(spark, tmp_path):
    store, said = JdbcStore(spark, f"jdbc:derby:memory:{tmp_path.name};create=true"), []
    store.create()
    row = ingest.normalize(envelopes(spark, 1), T0).first().asDict()
    with pytest.raises(ZeroDivisionError), store.transaction() as tx:
        tx.after_commit.append(lambda: said.append("commit"))
        tx.after_rollback.append(lambda: said.append("rollback"))
        assert store.insert_rows(tx, [row]) == 1
        1 / 0
    assert said == ["rollback"] and not states(store)
    with store.transaction() as tx:
        tx.after_commit.append(lambda: said.append("commit"))
        assert store.insert_rows(tx, [row | {"event_id": f"r{k:04d}"} for k in range(1001)]) == 1001
        assert tx.query(f"SELECT COUNT(*) AS n FROM {store.name} WHERE event_id >= ?", "r0500")[0] == {"n": 501}
        assert tx.update(f"UPDATE {store.name} SET attempts = ?, tenant_id = ?, locked_at = ? WHERE event_id = ?", 3, None, T0, "r0001") == 1
    assert said == ["rollback", "commit"]
    changed = store.read().where("event_id = 'r0001'").first()
    assert (changed.attempts, changed.tenant_id, changed.locked_at, changed.created_at) == (3, None, T0, T0)
    assert jdbc.read(spark, store.url, store.name).where(F.col("event_id") == "r0001")._jdf.queryExecution().executedPlan().toString().count("PushedFilters") == 1


def test_dialects_of_other_packages(monkeypatch):
    class Point:
        def load(self):
            return jdbc.Dialect("other", ("jdbc:other:",))

    monkeypatch.setattr(jdbc.importlib.metadata, "entry_points", lambda group: [Point()])
    monkeypatch.setattr(jdbc, "DIALECTS", dict(jdbc.DIALECTS))
    assert jdbc.discover() == ["other"] and jdbc.dialect_of("jdbc:other:x").name == "other"
