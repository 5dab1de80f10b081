"""The event table: columns, status codes, rules on names and sizes."""

from __future__ import annotations

import enum
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class Status(enum.IntEnum):
    NEW = 0
    DONE = 1
    RETRY = 2
    DEAD = 3


PENDING = (Status.NEW, Status.RETRY)
TERMINAL = (Status.DONE, Status.DEAD)
GLOBAL = "__GLOBAL__"
MAX_PAYLOAD_BYTES = 1 << 20
MAX_ERROR_CHARS = 4000

_text, _time = T.StringType(), T.TimestampNTZType()
EVENTS = T.StructType(
    [
        T.StructField("event_id", _text, False),
        T.StructField("event_type", _text, False),
        T.StructField("aggregate_type", _text),
        T.StructField("aggregate_id", _text),
        T.StructField("tenant_id", _text),
        T.StructField("payload", _text, False),
        T.StructField("headers", _text),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("attempts", T.IntegerType(), False),
        T.StructField("available_at", _time, False),
        T.StructField("created_at", _time, False),
        T.StructField("done_at", _time),
        T.StructField("last_error", _text),
        T.StructField("locked_by", _text),
        T.StructField("locked_at", _time),
    ]
)
COLUMNS = EVENTS.names
#: What a poll hands on: no status, lock or error columns.
POLLED = ["event_id", "event_type", "aggregate_type", "aggregate_id", "tenant_id", "payload", "headers", "attempts", "created_at", "available_at"]
#: The total order of all top-k reads.
ORDER = ["created_at", "event_id"]

#: A builder's input row, before defaults.
ENVELOPES = T.StructType(
    [T.StructField(n, _text) for n in ("event_id", "event_type", "aggregate_type", "aggregate_id", "tenant_id", "payload_json")]
    + [T.StructField("payload_bytes", T.BinaryType()), T.StructField("headers", T.MapType(_text, _text, True)), T.StructField("occurred_at", _time), T.StructField("available_at", _time), T.StructField("deliver_after_ms", T.LongType())]
)


def instant(at: datetime | str | Column) -> Column:
    """A point in time without zone; the clock is always an argument."""
    return at if isinstance(at, Column) else F.lit(str(at)).cast("timestamp_ntz")


def pending() -> Column:
    return F.col("status").isin(*map(int, PENDING))


def terminal() -> Column:
    return F.col("status").isin(*map(int, TERMINAL))


def status_name(status: Column) -> Column:
    out = F.when(status == int(Status.NEW), Status.NEW.name)
    for s in list(Status)[1:]:
        out = out.when(status == int(s), s.name)
    return out.otherwise("UNKNOWN")


def check_table_name(name: str) -> str:
    """Names are put into SQL, so nothing but a plain identifier passes."""
    if not re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name or ""):
        raise ValueError(f"not a table name: {name!r}")
    return name


def type_name(kind: object) -> str:
    """Text of an event or aggregate type, given as text or as an enum constant."""
    name = kind.name if isinstance(kind, enum.Enum) else kind
    if not isinstance(name, str) or not name:
        raise ValueError("a type needs a name")
    return name


#: The derived event table of the fixtures; the same text runs in Spark and in DuckDB.
DERIVED = """
with raw as (select e.*, cast(event_id % 10 as int) as b from events e),
ob as (select
  concat('evt-', lpad(cast(event_id as string), 9, '0')) as event_id,
  event_type,
  case when event_id % 3 = 0 then '__GLOBAL__' when event_id % 3 = 1 then 'User' else 'Order' end as aggregate_type,
  cast(user_id as string) as aggregate_id,
  case when event_id % 4 = 0 then null else concat('tenant-', cast(event_id % 4 as string)) end as tenant_id,
  props as payload,
  case when event_id % 6 = 0 then 'not-json' when event_id % 2 = 0 then concat('{"source":"', event_type, '"}') else null end as headers,
  cast(case when b < 3 then 0 when b < 6 then 1 when b < 8 then 2 else 3 end as int) as status,
  cast(case when b in (6,7) then 1 + event_id % 9 when b >= 8 then 9 else 0 end as int) as attempts,
  case when b in (6,7) then ts + interval '6' hour when event_id % 7 = 0 then ts + interval '1' day else ts end as available_at,
  ts as created_at,
  case when b in (3,4,5) then ts + interval '2' hour when b = 8 then ts + interval '3' hour else null end as done_at,
  case when b >= 6 then concat('boom-', event_type) else null end as last_error,
  case when b in (0,6) and event_id % 4 < 2 then concat('node-', cast(event_id % 4 as string)) else null end as locked_by,
  case when b in (0,6) and event_id % 4 < 2 then ts + interval '1' minute else null end as locked_at
  from raw)
"""


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table made from the driver's `events`."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    # format() would take the braces of the JSON text for fields
    text = DERIVED.replace("{", "{{").replace("}", "}}").replace("from events e", "from {source} e")
    return spark.sql(text + "select * from ob", source=source)
