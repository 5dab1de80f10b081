import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relayloom.functions.headers import decode_strict, encode_headers, needs_parser, parse_headers
from relayloom.functions.ids import format_ulid, ulid
from relayloom.operators import dispatch, ingest, purge, routing, scans, transitions
from relayloom.schema import ENVELOPES, EVENTS, GLOBAL, check_table_name, status_name, type_name

T0 = datetime(2024, 1, 10, 12)
S = timedelta(seconds=1)


def row(i, **more):
    base = {n: None for n in EVENTS.names} | {"event_id": i, "event_type": "t", "payload": "{}", "status": 0, "attempts": 0, "available_at": T0, "created_at": T0}
    return tuple((base | more).values())


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), EVENTS)


def ids(df):
    return [r.event_id for r in df.collect()]


def test_poll_bounds_are_inclusive_and_ignore_locks(table):
    t = table(row("b"), row("a"), row("later", available_at=T0 + S), row("done", status=1), row("locked", locked_by="x", locked_at=T0), row("retry", status=2))
    assert ids(scans.poll_pending(t, T0, 10)) == ["a", "b", "locked", "retry"]
    assert ids(scans.poll_pending(t, T0 + S, 10, S)) == ["a", "b", "later", "locked", "retry"]
    assert ids(scans.poll_pending(t, T0 + S, 10, S + timedelta(microseconds=1))) == []
    assert ids(scans.poll_pending(t, T0, 2)) == ["a", "b"]
    assert ids(scans.poll_pending(t, T0, 0)) == ids(scans.poll_pending(t, T0, -1)) == []


def test_claim_takes_free_and_strictly_expired(table):
    t = table(row("free"), row("expired", locked_by="x", locked_at=T0 - S), row("edge", locked_by="x", locked_at=T0), row("odd", locked_by="x"))
    assert ids(scans.claim_pending(t, "me", T0, T0, 10)) == ["expired", "free"]
    marked = scans.claim_marks(t, "me", T0, T0, 1)
    assert ids(scans.select_claimed(marked, "me", T0)) == ["expired"]
    assert ids(scans.claim_pending(marked, "you", T0, T0, 10)) == ["free"]


def test_marks_stop_at_terminal_rows(table):
    t = table(row("n", locked_by="x", locked_at=T0), row("d", status=1, done_at=T0), row("x", status=3, last_error="e"))
    both = t.select("event_id")
    done = {r.event_id: r for r in transitions.mark(t, both, "done", at=T0 + S).collect()}
    assert (done["n"].status, done["n"].done_at, done["n"].locked_by) == (1, T0 + S, None)
    assert done["d"].done_at == T0 and done["x"].status == 3
    again = {r.event_id: r for r in transitions.mark(t, both, "replay", at=T0 + S).collect()}
    assert (again["x"].status, again["x"].attempts, again["x"].last_error, again["x"].available_at) == (0, 0, None, T0 + S)
    assert again["n"].locked_by == "x" and again["d"].status == 1
    deferred = {r.event_id: r for r in transitions.mark(t, both, "defer", next_at=T0 + S).collect()}
    assert (deferred["n"].status, deferred["n"].attempts, deferred["n"].available_at) == (2, 0, T0 + S)


def step(state, c):
    """One command on a plain model of a row."""
    status, attempts, error = state
    if c == "replay":
        return (0, 0, None) if status == 3 else state
    if status in (1, 3):
        return state
    return {"done": (1, attempts, error), "retry": (2, attempts + 1, "e"), "defer": (2, attempts, error), "dead": (3, attempts, "e")}[c]


def test_fold_equals_a_plain_model(spark, table):
    rnd = random.Random(3)
    rows, commands, want = [], [], {}
    for k in range(300):
        state = (rnd.randrange(4), rnd.randrange(3), None)
        rows.append(row(str(k), status=state[0], attempts=state[1]))
        own = [rnd.choice(transitions.ACTIONS) for _ in range(rnd.randrange(6))]
        for c in own:
            state = step(state, c)
        want[str(k)] = state
        listed = [(str(k), s, c, T0, T0, "e") for s, c in enumerate(own)]
        rnd.shuffle(listed)
        commands += listed
    got = transitions.transition(table(*rows), spark.createDataFrame(commands, transitions.COMMANDS)).collect()
    assert {r.event_id: (r.status, r.attempts, r.last_error) for r in got} == want


def test_error_is_cut_at_4000(spark):
    made = spark.createDataFrame([("x" * n,) for n in (3999, 4000, 4001, 9000)], "e string").select(transitions.truncate_error(F.col("e")).alias("e")).collect()
    assert [len(r.e) for r in made] == [3999, 4000, 4000, 4000] and made[2].e.endswith("x...") and not made[1].e.endswith(".")


def test_purge_is_strict_and_falls_back_to_created_at(table):
    old, edge = T0 - S, T0
    t = table(row("1", status=1, done_at=old), row("2", status=1, done_at=edge), row("3", status=3, created_at=old), row("4", status=3), row("5", created_at=old), row("6", status=1, created_at=old, done_at=edge))
    assert sorted(ids(purge.candidates(t, purge.ended_before(T0), 10))) == ["1", "3"]
    assert sorted(ids(purge.candidates(t, purge.made_before(T0), 10))) == ["3", "5", "6"]
    assert sorted(ids(purge.survivors(t, purge.ended_before(T0), 1))) == ["1", "2", "4", "5", "6"]
    assert sorted(ids(purge.drain(t, purge.ended_before(T0)))) == ["2", "4", "5", "6"]


def test_routes(spark, table):
    r = routing.Routes().add("one", "c", "a:b").add("two", "b:c", "a").add("all", "e")
    with pytest.raises(ValueError):
        r.add("again", "e")
    for bad in ((None, "x"), ("l", ""), ("l", None)):
        with pytest.raises(ValueError):
            routing.Routes().add(*bad)
    t = table(row("1", aggregate_type="a:b", event_type="c"), row("2", aggregate_type="a", event_type="b:c"), row("3", event_type="e"), row("4", aggregate_type="User", event_type="e"))
    assert {x.event_id: x.listener for x in routing.route(t, r.frame(spark)).collect()} == {"1": "one", "2": "two", "3": "all", "4": None}
    assert ids(routing.unroutable(t, r.frame(spark))) == ["4"]
    assert r.listener_for(None, "e") == "all" and r.listener_for("User", "e") is None


@pytest.mark.parametrize(
    "text,want",
    [
        (None, {}), ("", {}), ("null", {}), ("{}", {}), ('{"a":null}', {}), ('{"a":"1",}', {"a": "1"}), ('{"a":"1"}x', {"a": "1"}), ('{"a":"1","a":"2"}', {"a": "2"}),
        (' { "a" : "b\\n\\u00e9\\ud83d\\ude00" } ', {"a": "b\né\U0001f600"}), ('{"a":1}', None), ('{"a":{"b":"c"}}', None), ('{"a":"\\ud800"}', None), ('{"a":"\\udc00"}', None),
        ('{"a":"\\q"}', None), ("not-json", None), ('["a"]', None), ('{"a":"b"', None), ('{"a" "b"}', None), ('{"a":"b', None), ('{"a":"\\u12g4"}', None),
    ],
)
def test_header_texts(text, want):
    if want is None:
        with pytest.raises(ValueError):
            parse_headers(text)
    else:
        assert parse_headers(text) == want


def test_header_columns(spark):
    texts = ['{"a":"1"}', None, "not-json", '{"a":"x\\"y"}', "{}", '{"k":"1","k":"2"}']
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    got = df.select(decode_strict(F.col("h")).alias("d"), needs_parser(F.col("h")).alias("p")).collect()
    assert [r.d.headers for r in got] == [{"a": "1"}, {}, None, {"a": 'x"y'}, {}, {"k": "2"}]
    assert [r.p for r in got][:5] == [False, False, True, True, False]
    maps = spark.createDataFrame([({"a": "b\x01"},), ({},), (None,), ({"k": None},)], "m map<string,string>")
    assert [r.h for r in maps.select(encode_headers(F.col("m")).alias("h")).collect()] == ['{"a":"b\\u0001"}', None, None, '{"k":null}']


def envelope(**more):
    base = {n: None for n in ENVELOPES.names} | {"event_id": "i", "event_type": "t", "payload_json": "{}", "occurred_at": T0}
    return tuple((base | more).values())


@pytest.mark.parametrize(
    "more,error",
    [
        ({}, None), ({"event_type": None}, "event_type_missing"), ({"event_type": ""}, "event_type_empty"), ({"available_at": T0, "deliver_after_ms": 1}, "two_delivery_times"),
        ({"deliver_after_ms": 0}, "delay_not_positive"), ({"deliver_after_ms": 1}, None), ({"available_at": T0 - S}, "available_before_occurred"), ({"available_at": T0}, None),
        ({"headers": {"a": None}}, "header_null"), ({"payload_json": None}, "payload_count"), ({"payload_bytes": b"x"}, "payload_count"), ({"payload_json": None, "payload_bytes": b"x"}, None),
        ({"payload_json": "x" * (1 << 20)}, None), ({"payload_json": "x" * (1 << 20) + "x"}, "payload_too_large"), ({"payload_json": "é" * (1 << 19)}, None), ({"payload_json": "é" * (1 << 19) + "x"}, "payload_too_large"),
        ({"event_type": None, "payload_json": None}, "event_type_missing"),
    ],
)
def test_envelope_rules(spark, more, error):
    assert ingest.validate(spark.createDataFrame([envelope(**more)], ENVELOPES), T0).first().error == error


def test_normalize_fills_in(spark):
    df = spark.createDataFrame([envelope(event_id=None, occurred_at=None), envelope(event_id="d", deliver_after_ms=1500), envelope(event_id="b", payload_json=None, payload_bytes="é".encode())], ENVELOPES)
    a, d, b = ingest.normalize(df, T0 + S).collect()
    assert len(a.event_id) == 26 and a.created_at == a.available_at == T0 + S and a.aggregate_type == GLOBAL and a.headers is None
    assert d.available_at == T0 + timedelta(milliseconds=1500) and b.payload == "é"


def test_ids_sort_by_time(spark):
    assert format_ulid(0, 0) == "0" * 26 and format_ulid((1 << 48) - 1, (1 << 80) - 1) == "7" + "Z" * 25
    made = [r.u for r in spark.createDataFrame([(T0 + k * S,) for k in range(50)], "t timestamp_ntz").coalesce(1).select(ulid(F.col("t")).alias("u")).collect()]
    assert made == sorted(made) and len(set(made)) == 50


def drain(hot, cold):
    """A worker that takes two of one queue, then one of the other, and what there is if one is empty."""
    hot, cold, out, c = list(hot), list(cold), [], 0
    while hot or cold:
        first, second = (cold, hot) if c % 3 == 2 else (hot, cold)
        out.append((first or second).pop(0))
        c += 1
    return out


def test_fair_merge_equals_a_worker(spark):
    rnd = random.Random(7)
    for h, c in [(0, 0), (0, 5), (5, 0), (1, 9), (9, 1)] + [(rnd.randrange(13), rnd.randrange(13)) for _ in range(6)]:
        hot, cold = [f"h{k}" for k in range(h)], [f"c{k}" for k in range(c)]
        frame = lambda xs: spark.createDataFrame([(x, k) for k, x in enumerate(xs)], "event_id string, rank long")
        assert ids(dispatch.fair_merge(frame(hot), frame(cold)).orderBy("position")) == drain(hot, cold)


def test_backoff(spark):
    ns = [-1, 0, 1, 2, 3, 9, 10, 30, 31, 99]
    df = spark.createDataFrame([(n,) for n in ns], "n int")
    got = [r[0] for r in df.select(dispatch.backoff_capped(F.col("n"), 100, 60_000)).collect()]
    assert got == [0, 0, 100, 200, 400, 25_600, 51_200, 60_000, 60_000, 60_000]
    spread = [r[0] for r in df.select(dispatch.backoff(F.col("n"), 100, 60_000)).collect()]
    assert all(g // 2 <= s <= min(60_000, g * 3 // 2) for g, s in zip(got, spread))
    low, high = dispatch.backoff_bounds(F.col("n"), 100, 60_000)
    assert [tuple(r) for r in df.select(low, high).collect()][2:5] == [(50, 150), (100, 300), (200, 600)]


def test_outcomes_in_order(spark):
    rows = [("lost", None, 0, "unroutable", None), ("hooked", None, 0, "failed", None), ("ok", "l", 0, "done", None), ("later", "l", 9, "retry_after", 5000), ("last", "l", 9, "failed", None), ("again", "l", 0, "failed", None), ("own", "l", 1, "failed_after", 0)]
    df = spark.createDataFrame([(i, None, "t", l, a, r, d, "boom") for i, l, a, r, d in rows], "event_id string, aggregate_type string, event_type string, listener string, attempts int, result string, result_delay_ms long, error string")
    got = {r.event_id: (r.action, r.next_at and (r.next_at - T0).total_seconds(), r.error) for r in dispatch.outcomes(df, T0).collect()}
    assert got == {"lost": ("dead", None, "no listener for __GLOBAL__/t"), "hooked": ("retry", 0.2, "boom"), "ok": ("done", None, None), "later": ("defer", 5.0, None), "last": ("dead", None, "boom"), "again": ("retry", 0.2, "boom"), "own": ("retry", 0.0, "boom")}


def test_interceptors():
    said = []
    note = lambda n, bad=False: dispatch.Interceptor(lambda e: said.append(f"+{n}") or (1 / 0 if bad else None), lambda e, x: said.append(f"-{n}") or 1 / 0)
    assert dispatch.deliver({}, lambda e: None, [note(1), note(2)]) == ("done", None, None)
    assert said == ["+1", "+2", "-2", "-1"]
    said.clear()
    assert dispatch.deliver({}, None, [note(1), note(2, True)])[0] == "failed" and said == ["+1", "+2", "-1"]
    assert dispatch.deliver({}, None) == ("unroutable", None, None)

    def ask(e):
        raise dispatch.RetryAfter(70)

    assert dispatch.deliver({}, ask)[:2] == ("failed_after", 70)
    assert dispatch.deliver({}, lambda e: dispatch.Result(30)) == ("retry_after", 30, None)
    for bad in (lambda: dispatch.RetryAfter(-1), lambda: dispatch.Result(-1)):
        with pytest.raises(ValueError):
            bad()


def test_decode_marks_what_cannot_be_delivered(table):
    t = table(row("ok", headers='{"a":"b"}'), row("none"), row("odd", headers='{"a":"b",}'), row("bad", headers="not-json"), row("early", available_at=T0 - S))
    got = {r.event_id: (r.header_map, r.decode_error) for r in dispatch.decode(t).collect()}
    assert got["ok"] == ({"a": "b"}, None) and got["none"] == ({}, None) and got["odd"] == ({"a": "b"}, None)
    assert got["bad"][1].startswith("headers: ") and got["early"][1] == "available_before_occurred"


def test_hot_split(table):
    t = table(row("a"), row("b"), row("c"), row("late", available_at=T0 + S))
    assert {r.event_id: r.fate for r in dispatch.hot_split(t, 2).collect()} == {"a": "accepted", "b": "accepted", "c": "dropped", "late": "delayed"}


def test_names():
    import enum

    assert check_table_name("a_1") == "a_1" and type_name(enum.Enum("E", "Made").Made) == "Made"
    for bad in ("1a", "a-b", "a;b", "", None, "a\n"):
        with pytest.raises(ValueError):
            check_table_name(bad)


def test_status_names(spark):
    df = spark.range(5).select(status_name(F.col("id")).alias("n"))
    assert [r.n for r in df.collect()] == ["NEW", "DONE", "RETRY", "DEAD", "UNKNOWN"]
