import datetime
import decimal

import duckdb
import pytest

from relayloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, values):
    return sorted(repr(sorted((n, plain(v)) for n, v in zip(names, r))) for r in values)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_equals_sql(spark, sf, duck, name):
    got = plans.queries()[name](spark, sf)
    found = got.collect()
    assert name in plans.oracle_sql()
    want = duck.execute(plans.oracle_sql()[name])
    assert rows(got.columns, found) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())


def test_plans_push_filters_and_take_the_top(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    poll = plan(plans.queries()["poll_pending"](spark, sf))
    assert "TakeOrderedAndProject" in poll
    # The runtime decides joins, so plans are looked at after they ran: chosen ids and routes are broadcast, the table is not shuffled.
    for name in ("purge_survivors", "claim_marks", "route_events"):
        made = plans.queries()[name](spark, sf)
        made.collect()
        final = plan(made)
        assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final and "isFinalPlan=true" in final
        assert "Exchange hashpartitioning" not in final
    scan = plan(plans.queries()["poll_pending"](spark, sf))
    assert "PushedFilters: [" in scan and "PushedFilters: []" not in scan


def test_queues_are_those_of_the_whole_table(spark, sf):
    from relayloom.operators.dispatch import ranked
    from relayloom.schema import derived_events

    events = derived_events(spark, sf).collect()
    number = {r.event_id: int(r.event_id[4:]) for r in events}
    hot = [r for r in events if r.status == 0]
    cold = [r for r in events if r.status == 2 or number[r.event_id] % 3 == 0]
    want = set()
    for queue, source, slot in ((hot, "HOT", lambda k: 3 * (k // 2) + k % 2), (cold, "COLD", lambda k: 3 * k + 2)):
        rank = {}
        for r in sorted(queue, key=lambda r: (r.created_at, r.event_id)):
            k = rank[r.aggregate_id] = rank.get(r.aggregate_id, -1) + 1
            want.add((r.aggregate_id, r.event_id, source, slot(k)))
    assert {tuple(r) for r in plans.queries()["fair_merge"](spark, sf).collect()} == want
    assert {tuple(r) for r in plans.queries()["queue_depths"](spark, sf).select("source", "depth").collect()} == {("HOT", len(hot)), ("COLD", len(cold))}
    ids = {r.event_id for r in hot}
    assert {tuple(r) for r in plans.queries()["inflight_dedupe"](spark, sf).collect()} == {(r.event_id, "HOT" if r.event_id in ids else "COLD") for r in hot + cold}

    now = datetime.datetime.fromisoformat(plans.NOW)
    due = sorted((r for r in events if r.status in (0, 2) and r.available_at <= now), key=lambda r: (r.created_at, r.event_id))
    got = plans.queries()["ordered_delivery"](spark, sf).collect()
    assert len({r.aggregate_id for r in due}) > 1
    assert sorted((r["rank"], r.event_id) for r in got) == list(enumerate(r.event_id for r in due))
    assert ranked(spark.createDataFrame([], "created_at timestamp_ntz, event_id string")).count() == 0
