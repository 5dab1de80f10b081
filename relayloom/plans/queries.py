"""Queries over the derived event table, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from relayloom.functions.headers import decode_headers, encode_headers
from relayloom.functions.times import plus_millis
from relayloom.operators import dispatch, ingest, metrics, purge, routing, scans, transitions
from relayloom.schema import DERIVED, GLOBAL, POLLED, derived_events as ob

NOW = "2024-01-25 00:00:00"
EXPIRY = "2024-01-20 00:00:00"
CUTOFF = "2024-01-18 00:00:00"
LIMIT, DEAD_LIMIT, PURGE_LIMIT, CAPACITY = 50, 20, 500, 30
HOUR = timedelta(hours=1)
ROUTES = [("User", "signup", "welcome"), ("Order", "purchase", "billing"), (GLOBAL, "error", "alerts"), ("a:b", "c", "colon1"), ("a", "b:c", "colon2"), ("User", "view", "views"), ("Order", "view", "views"), ("Order", "click", "clicks")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_NOW, _EXPIRY, _CUTOFF = (f"timestamp '{x}'" for x in (NOW, EXPIRY, CUTOFF))
_COLS = ", ".join(POLLED)
_DUE = f"status in (0, 2) and available_at <= {_NOW}"
_FREE = f"(locked_by is null or locked_at < {_EXPIRY})"
_OLDEST = "order by created_at, event_id"
_ROUTES = "routes(aggregate_type, event_type, listener) as (values " + ", ".join(map(str, ROUTES)) + ")"


def query(sql: str | None = None, raw: bool = False):
    """Register a query and, over the derived table `ob` unless raw, its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql if raw else DERIVED + sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# Scans


@query(f"select {_COLS} from ob where {_DUE} and created_at <= {_NOW} {_OLDEST} limit {LIMIT}")
def poll_pending(spark, sf_dir):
    return scans.poll_pending(ob(spark, sf_dir), NOW, LIMIT)


@query(f"select {_COLS} from ob where {_DUE} and created_at <= {_NOW} - interval '1' hour {_OLDEST} limit {LIMIT}")
def poll_skip_recent(spark, sf_dir):
    return scans.poll_pending(ob(spark, sf_dir), NOW, LIMIT, HOUR)


@query(f"select {_COLS} from ob where {_DUE} and created_at <= {_NOW} {_OLDEST} limit {CAPACITY}")
def poll_capacity(spark, sf_dir):
    return scans.poll_pending(ob(spark, sf_dir), NOW, min(LIMIT, CAPACITY))


@query(f"select {_COLS} from ob where {_DUE} and created_at <= {_NOW} and {_FREE} {_OLDEST} limit {LIMIT}")
def claim_pending(spark, sf_dir):
    return scans.claim_pending(ob(spark, sf_dir), "node-9", NOW, EXPIRY, LIMIT)


_MARKED = f"""chosen as (select event_id from ob where {_DUE} and created_at <= {_NOW} and {_FREE} {_OLDEST} limit {LIMIT}),
marked as (select ob.* exclude (locked_by, locked_at), case when c.event_id is null then locked_by else 'node-9' end locked_by,
  case when c.event_id is null then locked_at else {_NOW} end locked_at from ob left join chosen c on ob.event_id = c.event_id)"""


@query(f", {_MARKED} select * from marked")
def claim_marks(spark, sf_dir):
    return scans.claim_marks(ob(spark, sf_dir), "node-9", NOW, EXPIRY, LIMIT)


@query(f", {_MARKED} select {_COLS} from marked where locked_by = 'node-9' and locked_at = {_NOW}")
def select_claimed(spark, sf_dir):
    return scans.select_claimed(scans.claim_marks(ob(spark, sf_dir), "node-9", NOW, EXPIRY, LIMIT), "node-9", NOW)


@query(f"select {_COLS} from ob where {_DUE} and created_at <= {_NOW} - interval '1' hour and {_FREE} {_OLDEST} limit {LIMIT}")
def claim_skip_recent(spark, sf_dir):
    return scans.claim_pending(ob(spark, sf_dir), "node-9", NOW, EXPIRY, LIMIT, HOUR)


@query(f"select * replace ('node-9' as locked_by, {_NOW} as locked_at) from ob where {_DUE} and created_at <= {_NOW} and {_FREE} {_OLDEST} limit {LIMIT}")
def claim_rows(spark, sf_dir):
    """What a claim writes: its rows alone."""
    return scans.claim_rows(ob(spark, sf_dir), "node-9", NOW, EXPIRY, LIMIT)


@query("select * from ob where event_id = 'evt-000000007'")
def event_by_id(spark, sf_dir):
    return scans.by_id(ob(spark, sf_dir), "evt-000000007")


@query(f"select {_COLS} from ob where status = 3 {_OLDEST} limit {DEAD_LIMIT}")
def query_dead(spark, sf_dir):
    return scans.query_dead(ob(spark, sf_dir), DEAD_LIMIT)


@query(f"select {_COLS} from ob where status = 3 and event_type = 'click' {_OLDEST} limit {DEAD_LIMIT}")
def query_dead_by_type(spark, sf_dir):
    return scans.query_dead(ob(spark, sf_dir), DEAD_LIMIT, "click")


@query(f"select {_COLS} from ob where status = 3 and event_type = 'click' and aggregate_type = 'User' {_OLDEST} limit {DEAD_LIMIT}")
def query_dead_by_both(spark, sf_dir):
    return scans.query_dead(ob(spark, sf_dir), DEAD_LIMIT, "click", "User")


@query("select count(*) n_dead from ob where status = 3")
def count_dead(spark, sf_dir):
    return scans.count_dead(ob(spark, sf_dir))


@query("select count(*) n_dead from ob where status = 3 and event_type = 'error'")
def count_dead_by_type(spark, sf_dir):
    return scans.count_dead(ob(spark, sf_dir), "error")


@query("select * from ob order by created_at desc, event_id limit 20")
def recent_events(spark, sf_dir):
    return scans.recent(ob(spark, sf_dir))


@query("select event_id, status, case status when 0 then 'NEW' when 1 then 'DONE' when 2 then 'RETRY' when 3 then 'DEAD' end status_name from ob")
def status_names(spark, sf_dir):
    return scans.with_status_name(ob(spark, sf_dir)).select("event_id", "status", "status_name")


@query(f"select event_id, available_at from ob where {_DUE}")
def due_events(spark, sf_dir):
    return scans.due(ob(spark, sf_dir), NOW).select("event_id", "available_at")


@query("select event_id, created_at, available_at from ob where available_at > created_at")
def delayed_events(spark, sf_dir):
    return scans.delayed(ob(spark, sf_dir)).select("event_id", "created_at", "available_at")


@query("select * from ob")
def cdc_dedupe(spark, sf_dir):
    """A feed that delivers a third of the rows twice gives the table back."""
    feed = ob(spark, sf_dir)
    again = feed.where("cast(substring(event_id, 5) as bigint) % 3 = 0")
    return scans.dedupe(feed.unionAll(again)).select(feed.columns)


@query(f"select event_id, row_number() over ({_OLDEST}) - 1 as rank from ob where {_DUE}")
def ordered_delivery(spark, sf_dir):
    """The order in which one worker delivers the due events of the whole table."""
    return dispatch.ranked(scans.due(ob(spark, sf_dir), NOW).select("event_id", "created_at")).select("event_id", "rank")


# Transitions

_LIVE = "status not in (1, 3) and event_type = 'click'"
_ERR = "concat('failed ', event_type)"


def _set(hit: str, **made: str) -> str:
    changed = {"locked_by": "null", "locked_at": "null"} | made
    casts = {"status": "int", "attempts": "int", "last_error": "varchar", "locked_by": "varchar"}
    cols = "event_id event_type aggregate_type aggregate_id tenant_id payload headers status attempts available_at created_at done_at last_error locked_by locked_at".split()
    return "select " + ", ".join(f"cast(case when {hit} then {changed[c]} else {c} end as {casts.get(c, 'timestamp')}) {c}" if c in changed else c for c in cols) + " from ob"


def _mark(spark, sf_dir, action, **how):
    events = ob(spark, sf_dir)
    return transitions.mark(events, events.where("event_type = 'click'"), action, **how)


@query(_set(_LIVE, status="1", done_at=_NOW))
def mark_done(spark, sf_dir):
    return _mark(spark, sf_dir, "done", at=NOW)


@query(_set(_LIVE, status="2", attempts="attempts + 1", available_at=f"{_NOW} + interval '1' minute", last_error=_ERR))
def mark_retry(spark, sf_dir):
    return _mark(spark, sf_dir, "retry", next_at="2024-01-25 00:01:00", error=F.concat(F.lit("failed "), "event_type"))


@query(_set(_LIVE, status="2", available_at=f"{_NOW} + interval '1' minute"))
def mark_deferred(spark, sf_dir):
    return _mark(spark, sf_dir, "defer", next_at="2024-01-25 00:01:00")


@query(_set(_LIVE, status="3", done_at=_NOW, last_error=_ERR))
def mark_dead(spark, sf_dir):
    return _mark(spark, sf_dir, "dead", at=NOW, error=F.concat(F.lit("failed "), "event_type"))


_REPLAYED = dict(status="0", attempts="0", available_at=_NOW, done_at="null", last_error="null")


@query(_set("status = 3 and event_type = 'click'", **_REPLAYED))
def replay_dead(spark, sf_dir):
    return _mark(spark, sf_dir, "replay", at=NOW)


@query(_set("status = 3", **_REPLAYED))
def replay_all(spark, sf_dir):
    return transitions.replay_all(ob(spark, sf_dir), NOW)


@query("select count(*) n_replayed from ob where status = 3 and aggregate_type = 'Order'")
def replay_all_count(spark, sf_dir):
    before = ob(spark, sf_dir)
    after = transitions.replay_all(before, NOW, aggregate_type="Order")
    changed = before.where("status = 3").select("event_id").join(after.where("status = 0").select("event_id"), "event_id", "left_semi")
    return changed.agg(F.count("*").alias("n_replayed"))


@query("select event_id, case when length(e) > 4000 then concat(substring(e, 1, 3997), '...') else e end as error from (select event_id, repeat(concat(event_type, event_id), cast(user_id as int) + 150) e from (select concat('evt-', lpad(cast(event_id as string), 9, '0')) event_id, event_type, user_id from events) x) y", raw=True)
def truncate_error(spark, sf_dir):
    events = ob(spark, sf_dir)
    long = F.repeat(F.concat("event_type", "event_id"), F.col("aggregate_id").cast("int") + 150)
    return events.select("event_id", transitions.truncate_error(long).alias("error"))


_FIVE = ("retry", "retry", "done", "retry"), ("dead", "done"), ("defer",), ("dead", "replay"), ("replay",)


def _commands(events: DataFrame) -> DataFrame:
    """A sequence of commands for each event, by the last digit of its number."""
    kinds = F.array(*[F.array(*map(F.lit, s)) for s in _FIVE])
    number = F.substring("event_id", 5, 9).cast("long")
    made = events.select("event_id", "created_at", F.posexplode(F.element_at(kinds, (F.pmod(number, F.lit(5)) + 1).cast("int"))).alias("seq", "action"))
    at = F.lit(NOW).cast("timestamp_ntz")
    return made.select("event_id", F.col("seq").cast("long").alias("seq"), "action", at.alias("at"), plus_millis(at, (F.col("seq") + 1) * 60_000).alias("next_at"), F.concat(F.lit("e"), F.col("seq").cast("string")).alias("error"))


_FOLD = f"""select event_id,
  cast(case when n = 0 then case when status in (1, 3) then status else 1 end
            when n = 1 then case when status in (1, 3) then status else 3 end
            when n = 2 then case when status in (1, 3) then status else 2 end
            when n = 3 then case when status = 1 then 1 else 0 end
            else case when status = 3 then 0 else status end end as int) status,
  cast(case when n = 0 and status not in (1, 3) then attempts + 2 when n = 3 and status <> 1 then 0 when n = 4 and status = 3 then 0 else attempts end as int) attempts,
  case when n = 0 and status not in (1, 3) then {_NOW} + interval '2' minute when n = 2 and status not in (1, 3) then {_NOW} + interval '1' minute
       when n = 3 and status <> 1 then {_NOW} when n = 4 and status = 3 then {_NOW} else available_at end available_at,
  case when n in (0, 1) and status not in (1, 3) then {_NOW} when n = 3 and status <> 1 then null when n = 4 and status = 3 then null else done_at end done_at,
  case when n = 0 and status not in (1, 3) then 'e1' when n = 1 and status not in (1, 3) then 'e0' when n = 3 and status <> 1 then null when n = 4 and status = 3 then null else last_error end last_error,
  cast(case when n = 0 and status not in (1, 3) then 3 when n in (1, 2) and status not in (1, 3) then 1 when n = 3 and status = 3 then 1 when n = 3 and status <> 1 then 2 when n = 4 and status = 3 then 1 else 0 end as int) applied
  from (select *, cast(substring(event_id, 5) as bigint) % 5 n from ob) x"""


@query(_FOLD)
def transition_fold(spark, sf_dir):
    events = ob(spark, sf_dir)
    return transitions.transition(events, _commands(events)).select("event_id", "status", "attempts", "available_at", "done_at", "last_error", "applied")


@query("select 'done' as action, count(*) as n_rows from ob where status not in (1, 3) union all select 'replay', count(*) from ob where status = 3")
def transition_counts(spark, sf_dir):
    events = ob(spark, sf_dir)
    commands = events.select("event_id", F.explode(F.array(F.lit("done"), F.lit("replay"))).alias("action"))
    return transitions.affected(events, commands)


# Purge

_ENDED = f"(status in (1, 3) and (done_at < {_CUTOFF} or (done_at is null and created_at < {_CUTOFF})))"


@query(f"select event_id from ob where {_ENDED} {_OLDEST} limit {PURGE_LIMIT}")
def purge_candidates(spark, sf_dir):
    return purge.candidates(ob(spark, sf_dir), purge.ended_before(CUTOFF), PURGE_LIMIT)


@query(f"select * from ob where event_id not in (select event_id from ob where {_ENDED} {_OLDEST} limit {PURGE_LIMIT})")
def purge_survivors(spark, sf_dir):
    return purge.survivors(ob(spark, sf_dir), purge.ended_before(CUTOFF), PURGE_LIMIT)


@query(f"select event_id from ob where created_at < {_CUTOFF} {_OLDEST} limit {PURGE_LIMIT}")
def purge_by_age(spark, sf_dir):
    return purge.candidates(ob(spark, sf_dir), purge.made_before(CUTOFF), PURGE_LIMIT)


@query(f"select count(*) n_purged from ob where {_ENDED}")
def purge_drain_count(spark, sf_dir):
    events = ob(spark, sf_dir)
    left = purge.drain(events, purge.ended_before(CUTOFF)).agg(F.count("*").alias("left"))
    return events.agg(F.count("*").alias("all")).crossJoin(left).select((F.col("all") - F.col("left")).alias("n_purged"))  # one row each


# Ingest


def _envelopes(spark, sf_dir) -> DataFrame:
    """Envelopes made from events: each of the rules is broken by some."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 11
    null = F.lit(None)
    return events.select(
        F.concat(F.lit("id-"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(n == 1, null).when(n == 2, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(n == 9, null).otherwise("User").alias("aggregate_type"),
        F.col("user_id").cast("string").alias("aggregate_id"),
        null.cast("string").alias("tenant_id"),
        F.when(n == 7, null).when(n == 8, F.repeat(F.lit("é"), 524_289)).otherwise(F.col("props")).alias("payload_json"),
        null.cast("binary").alias("payload_bytes"),
        F.when(n == 6, F.create_map(F.lit("k"), null.cast("string"))).when(n == 10, F.create_map(F.lit("k"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>")).alias("headers"),
        F.col("ts").alias("occurred_at"),
        F.when(n == 5, plus_millis(F.col("ts"), F.lit(-1))).when(n == 3, F.col("ts")).when(n == 0, F.col("ts")).alias("available_at"),
        F.when(n == 3, 5).when(n == 4, 0).when(n == 10, 1500).cast("long").alias("deliver_after_ms"),
    )


@query("select concat('id-', cast(event_id as string)) event_id, case event_id % 11 when 1 then 'event_type_missing' when 2 then 'event_type_empty' when 3 then 'two_delivery_times' when 4 then 'delay_not_positive' when 5 then 'available_before_occurred' when 6 then 'header_null' when 7 then 'payload_count' when 8 then 'payload_too_large' end as error from events", raw=True)
def validate_envelope(spark, sf_dir):
    return ingest.validate(_envelopes(spark, sf_dir), NOW).select("event_id", "error")


@query(
    """select concat('id-', cast(event_id as string)) event_id, event_type, case when event_id % 11 = 9 then '__GLOBAL__' else 'User' end aggregate_type,
  cast(user_id as string) aggregate_id, cast(null as varchar) tenant_id, props payload, case when event_id % 11 = 10 then concat('{"k":"', event_type, '"}') end headers,
  cast(0 as int) status, cast(0 as int) attempts, case when event_id % 11 = 10 then ts + interval '1500' millisecond else ts end available_at, ts created_at,
  cast(null as timestamp) done_at, cast(null as varchar) last_error, cast(null as varchar) locked_by, cast(null as timestamp) locked_at
  from events where event_id % 11 in (0, 9, 10)""",
    raw=True,
)
def ingest_normalized(spark, sf_dir):
    return ingest.normalize(_envelopes(spark, sf_dir), NOW)


@query("select event_id, event_type, cast((row_number() over (partition by event_type order by created_at, event_id) - 1) // 500 as bigint) chunk from ob")
def ingest_chunks(spark, sf_dir):
    return ingest.chunked(ob(spark, sf_dir), per="event_type").select("event_id", "event_type", "chunk")


@query("select event_id, upper(event_type) event_type from ob where tenant_id is not null")
def write_suppress(spark, sf_dir):
    """Hooks may rewrite rows and hold some back."""

    class Hook(ingest.WriterHook):
        def before_write(self, events):
            return events.where(F.col("tenant_id").isNotNull()).withColumn("event_type", F.upper("event_type"))

    written = []
    ids = ingest.write(ob(spark, sf_dir), written.append, [Hook()])
    return written[0].join(ids, "event_id", "left_semi").select("event_id", "event_type")


@query("select event_id, created_at + interval '90' second \"at\" from ob")
def deliver_after(spark, sf_dir):
    return ob(spark, sf_dir).select("event_id", ingest.deliver_after(F.col("created_at"), F.lit(90_000)).alias("at"))


@query("""select event_id, case when user_id % 3 = 0 then null else concat('{"type":"', event_type, '","user":"', cast(user_id as string), '"}') end headers from events""", raw=True)
def headers_encode(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    empty = F.create_map().cast("map<string,string>")
    return events.select("event_id", encode_headers(F.when(F.col("user_id") % 3 == 0, empty).otherwise(made)).alias("headers"))


@query("select event_id, case when headers like '{%' then event_type end as source, headers = 'not-json' and headers is not null as broken from ob")
def headers_decode(spark, sf_dir):
    decoded = ob(spark, sf_dir).select("event_id", decode_headers(F.col("headers")).alias("d"))
    return decoded.select("event_id", F.element_at("d.headers", F.lit("source")).alias("source"), F.col("d.error").isNotNull().alias("broken"))


@query("select event_id from ob where headers = 'not-json' or available_at < created_at")
def decode_failures(spark, sf_dir):
    return dispatch.decode(ob(spark, sf_dir)).where("decode_error is not null").select("event_id")


# Routing and dispatch


def _routes(spark) -> DataFrame:
    out = routing.Routes()
    for aggregate_type, event_type, listener in ROUTES:
        out.add(listener, event_type, aggregate_type)
    return out.frame(spark)


@query(f", {_ROUTES} select ob.event_id, ob.aggregate_type, ob.event_type, listener from ob left join routes r on r.aggregate_type = ob.aggregate_type and r.event_type = ob.event_type")
def route_events(spark, sf_dir):
    return routing.route(ob(spark, sf_dir), _routes(spark)).select("event_id", "aggregate_type", "event_type", "listener")


@query(f", {_ROUTES} select event_id from ob where not exists (select 1 from routes r where r.aggregate_type = ob.aggregate_type and r.event_type = ob.event_type)")
def unroutable_events(spark, sf_dir):
    return routing.unroutable(ob(spark, sf_dir), _routes(spark)).select("event_id")


@query("select aggregate_type, event_type, count(*) n_listeners from ob group by 1, 2 having count(*) > 1")
def duplicate_routes(spark, sf_dir):
    """Every event as a route of its pair."""
    return routing.duplicates(ob(spark, sf_dir).select("aggregate_type", "event_type", F.col("event_id").alias("listener")))


_FATE = f"""fates as (select event_id, case when available_at > created_at then 'delayed' when row_number() over (partition by available_at > created_at {_OLDEST}) <= {CAPACITY} then 'accepted' else 'dropped' end fate from ob)"""


@query(f", {_FATE} select * from fates")
def hot_path_split(spark, sf_dir):
    return dispatch.hot_split(ob(spark, sf_dir), CAPACITY).select("event_id", "fate")


@query(f", {_FATE} select fate, count(*) n_events from fates group by 1")
def hot_accept_drop(spark, sf_dir):
    return dispatch.hot_split(ob(spark, sf_dir), CAPACITY).groupBy("fate").agg(F.count("*").alias("n_events"))


def _queues(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Fresh events are hot, a poll's are cold; a third of the latter are in both."""
    events = ob(spark, sf_dir)
    columns = ["event_id", "created_at", "aggregate_id"]
    return tuple(dispatch.numbered(events.where(w).select(columns), within="aggregate_id") for w in ("status = 0", "status = 2 or cast(substring(event_id, 5) as bigint) % 3 = 0"))


_QUEUES = """hot as (select event_id, created_at, aggregate_id, row_number() over (partition by aggregate_id order by created_at, event_id) - 1 as rank from ob where status = 0),
cold as (select event_id, created_at, aggregate_id, row_number() over (partition by aggregate_id order by created_at, event_id) - 1 as rank from ob where status = 2 or cast(substring(event_id, 5) as bigint) % 3 = 0),
merged as (select *, 'HOT' source, cast(3 * (rank // 2) + rank % 2 as bigint) "position" from hot union all select *, 'COLD', cast(3 * rank + 2 as bigint) from cold)"""


@query(f', {_QUEUES} select aggregate_id, event_id, source, "position" from merged')
def fair_merge(spark, sf_dir):
    return dispatch.fair_merge(*_queues(spark, sf_dir)).select("aggregate_id", "event_id", "source", "position")


@query(f", {_QUEUES} select source, count(*) depth from merged group by 1")
def queue_depths(spark, sf_dir):
    return metrics.queue_depths(dispatch.fair_merge(*_queues(spark, sf_dir)))


@query(f", {_QUEUES} select event_id, case when min(case when source = 'HOT' then 0 else 1 end) = 0 then 'HOT' else 'COLD' end source from merged group by 1")
def inflight_dedupe(spark, sf_dir):
    return dispatch.inflight_dedupe(dispatch.fair_merge(*_queues(spark, sf_dir))).select("event_id", "source")


_RESULTS = "case cast(substring(event_id, 5) as bigint) % 4 when 0 then 'done' when 1 then 'retry_after' when 2 then 'failed' else 'failed_after' end"


def _delivered(spark, sf_dir) -> DataFrame:
    routed = routing.route(scans.due(ob(spark, sf_dir), NOW), _routes(spark))
    result = F.when(F.col("listener").isNull(), "unroutable").otherwise(F.expr(_RESULTS))
    return routed.withColumns({"result": result, "result_delay_ms": F.lit(7000).cast("long"), "error": F.lit("boom")})


_BACKOFF = "case when attempts + 1 <= 0 then 0 when attempts + 1 >= 31 then 60000 else least(60000, 200 * cast(pow(2, attempts) as bigint)) end"
_COMMANDS = f"""{_ROUTES}, handled as (select ob.*, listener, {_RESULTS.replace('event_id', 'ob.event_id')} result from ob left join routes r on r.aggregate_type = ob.aggregate_type and r.event_type = ob.event_type where {_DUE}),
acts as (select *, case when listener is null then 'dead' when result = 'done' then 'done' when result = 'retry_after' then 'defer' when attempts + 1 >= 10 then 'dead' else 'retry' end "action" from handled)"""


@query(
    f""", {_COMMANDS} select event_id, cast(0 as bigint) seq, "action", {_NOW} "at",
  case when "action" in ('retry', 'defer') then {_NOW} + to_milliseconds(case when result in ('retry_after', 'failed_after') then 7000 else {_BACKOFF} end) end next_at,
  case when listener is null then concat('no listener for ', aggregate_type, '/', event_type) when "action" in ('dead', 'retry') then 'boom' end error from acts"""
)
def dispatch_outcomes(spark, sf_dir):
    return dispatch.outcomes(_delivered(spark, sf_dir), NOW)


@query(
    f""", {_ROUTES}, handled as (select ob.*, listener, case when cast(aggregate_id as int) % 5 = 0 then 'failed' when listener is null then 'unroutable' else 'done' end result
  from ob left join routes r on r.aggregate_type = ob.aggregate_type and r.event_type = ob.event_type where {_DUE}),
acts as (select *, case when result = 'unroutable' then 'dead' when result = 'done' then 'done' when attempts + 1 >= 10 then 'dead' else 'retry' end "action" from handled)
select event_id, cast(0 as bigint) seq, "action", {_NOW} "at", case when "action" = 'retry' then {_NOW} + to_milliseconds({_BACKOFF}) end next_at,
  case when result = 'unroutable' then concat('no listener for ', aggregate_type, '/', event_type) when "action" in ('dead', 'retry') then 'ValueError: not this user' end error from acts"""
)
def interceptor_outcomes(spark, sf_dir):
    """A hook refuses some users before the listener is looked up: their events are tried again, routable or not."""

    def before(event):
        if int(event["aggregate_id"]) % 5 == 0:
            raise ValueError("not this user")

    routed = routing.route(scans.due(ob(spark, sf_dir), NOW), _routes(spark))
    handlers = dict.fromkeys((listener for _, _, listener in ROUTES), lambda event: None)
    return dispatch.outcomes(dispatch.handle(routed, handlers, [dispatch.Interceptor(before)]), NOW)


@query(
    f""", {_FATE}, {_COMMANDS}, polled as (select event_id from ob where {_DUE} and created_at <= {_NOW} {_OLDEST} limit {LIMIT})
select (select count(*) from fates where fate = 'accepted') hot_enqueued, (select count(*) from fates where fate = 'dropped') hot_dropped, (select count(*) from fates where fate = 'delayed') hot_delayed,
  (select count(*) from polled) cold_enqueued, count(*) filter (where "action" = 'done') dispatch_success, count(*) filter (where "action" = 'retry') dispatch_failure,
  count(*) filter (where "action" = 'defer') dispatch_deferred, count(*) filter (where "action" = 'dead') dispatch_dead from acts"""
)
def dispatch_counters(spark, sf_dir):
    events = ob(spark, sf_dir)
    return metrics.counters(dispatch.hot_split(events, CAPACITY), scans.poll_pending(events, NOW, LIMIT), dispatch.outcomes(_delivered(spark, sf_dir), NOW))


@query("select count(*) n, coalesce(sum(ms), 0)::bigint sum_ms, max(ms) max_ms from (select date_diff('millisecond', created_at, done_at) ms from ob where status = 1) x where ms >= 0")
def dispatch_latency(spark, sf_dir):
    return metrics.dispatch_latency(ob(spark, sf_dir).where("status = 1"))


@query(f"select greatest(coalesce(date_sub('millisecond', min(created_at), {_NOW}), 0), 0) oldest_lag_ms from (select created_at from ob where {_DUE} and created_at <= {_NOW} {_OLDEST} limit {LIMIT}) x")
def oldest_lag_ms(spark, sf_dir):
    return metrics.oldest_lag(scans.poll_pending(ob(spark, sf_dir), NOW, LIMIT), NOW)


@query(
    """select event_id, case when n <= 0 then 0 else cast(floor(capped * 0.5) as bigint) end least_ms, case when n <= 0 then 0 else least(60000, cast(floor(capped * 1.5) as bigint)) end most_ms
  from (select event_id, n, case when n >= 31 then 60000 when n <= 0 then 0 else least(60000, 200 * cast(pow(2, n - 1) as bigint)) end capped from (select event_id, cast(user_id % 40 as int) - 2 n from events) x) y""",
    raw=True,
)
def backoff_bounds(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    least, most = dispatch.backoff_bounds((F.col("user_id") % 40).cast("int") - 2)
    return events.select("event_id", least.alias("least_ms"), most.alias("most_ms"))


@query(
    f""", {_ROUTES}, polled as (select {_COLS} from ob where {_DUE} and created_at <= {_NOW} {_OLDEST} limit {CAPACITY})
select event_id, case when headers = 'not-json' then null else listener end listener, coalesce(headers = 'not-json', false) or available_at < created_at as broken from polled p left join routes r using (aggregate_type, event_type)"""
)
def poll_cycle(spark, sf_dir):
    got = dispatch.poll_cycle(ob(spark, sf_dir), _routes(spark), NOW, LIMIT, CAPACITY)
    broken = F.col("decode_error").isNotNull()
    return got.select("event_id", F.when(~broken, F.col("listener")).alias("listener"), broken.alias("broken"))
