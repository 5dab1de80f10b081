"""Tables in databases: dialects by URL, the statements that a database must run, and a store that runs them.

Reads push filters to the database through Spark's JDBC source. Locks and updates in place are the database's own:
`JdbcStore` runs their statements on a connection of the driver, in transactions, in batches that limits bound.
"""

from __future__ import annotations

import importlib.metadata
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, functions as F

from relayloom.operators import transitions
from relayloom.schema import COLUMNS, EVENTS, POLLED, check_table_name

#: Rows of an insert statement, and ids of an IN list, at most.
ROWS = 500


@dataclass(frozen=True)
class Dialect:
    name: str
    prefixes: tuple[str, ...]
    json_value: str = "?"
    skip_locked: bool = False
    returning: bool = False
    delete_limit: bool = False
    first: str = "LIMIT ?"
    #: Whether Spark's writer can bind nulls to its texts.
    spark_writes: bool = True
    #: Types of texts without a bound, of times, and of the status.
    text: str = "CLOB"
    time: str = "TIMESTAMP"
    small: str = "SMALLINT"

    def create(self, table: str) -> str:
        """The table and its index for polls, as two statements divided by a semicolon."""
        sizes = {"event_id": 36, "event_type": 128, "aggregate_type": 64, "aggregate_id": 128, "tenant_id": 64, "locked_by": 128}
        kinds = {"status": self.small, "attempts": "INT DEFAULT 0", "payload": self.text, "headers": self.text, "last_error": "CLOB" if self.text == "CLOB" else "TEXT"}
        must = {f.name for f in EVENTS.fields if not f.nullable}
        columns = [f"{c} {f'VARCHAR({sizes[c]})' if c in sizes else kinds.get(c, self.time)}{' NOT NULL' if c in must else ''}{' PRIMARY KEY' if c == 'event_id' else ''}" for c in COLUMNS]
        return f"CREATE TABLE {check_table_name(table)} ({', '.join(columns)}); CREATE INDEX idx_{table}_due ON {table} (status, available_at, created_at)"

    def insert(self, table: str, rows: int = 1) -> str:
        one = "(" + ", ".join(self.json_value if c in ("payload", "headers") else "?" for c in COLUMNS) + ")"
        return f"INSERT INTO {check_table_name(table)} ({', '.join(COLUMNS)}) VALUES " + ", ".join([one] * rows)

    def claim(self, table: str) -> list[str]:
        """Statements of one claim, to be run in a transaction."""
        check_table_name(table)
        free = f"status IN (0, 2) AND available_at <= ? AND created_at <= ? AND (locked_by IS NULL OR locked_at < ?) ORDER BY created_at, event_id {self.first}"
        if self.returning:
            return [f"WITH due AS (SELECT event_id FROM {table} WHERE {free} FOR UPDATE SKIP LOCKED) UPDATE {table} t SET locked_by = ?, locked_at = ? FROM due WHERE t.event_id = due.event_id RETURNING {', '.join('t.' + c for c in POLLED)}"]
        if self.skip_locked:
            return [f"SELECT {', '.join(POLLED)} FROM {table} WHERE {free} FOR UPDATE SKIP LOCKED", f"UPDATE {table} SET locked_by = ?, locked_at = ? WHERE event_id IN (%s)"]
        return [f"UPDATE {table} SET locked_by = ?, locked_at = ? WHERE event_id IN (SELECT event_id FROM {table} WHERE {free})", f"SELECT {', '.join(POLLED)} FROM {table} WHERE locked_by = ? AND locked_at = ? ORDER BY created_at, event_id"]

    def poll(self, table: str) -> str:
        return f"SELECT {', '.join(POLLED)} FROM {check_table_name(table)} WHERE status IN (0, 2) AND available_at <= ? AND created_at <= ? ORDER BY created_at, event_id {self.first}"

    def dead(self, table: str, event_type: bool, aggregate_type: bool, count: bool = False) -> str:
        where = "status = 3" + " AND event_type = ?" * event_type + " AND aggregate_type = ?" * aggregate_type
        what = "COUNT(*) AS n" if count else ", ".join(POLLED)
        return f"SELECT {what} FROM {check_table_name(table)} WHERE {where}" + ("" if count else f" ORDER BY created_at, event_id {self.first}")

    def mark(self, table: str, action: str) -> str:
        """One event's change, for `MARKS[action]` as its values and the event's id; rows that it does not apply to stay."""
        sets = {
            "done": "status = 1, done_at = ?",
            "retry": "status = 2, attempts = attempts + 1, available_at = ?, last_error = ?",
            "defer": "status = 2, available_at = ?",
            "dead": "status = 3, done_at = ?, last_error = ?",
            "replay": "status = 0, attempts = 0, available_at = ?, done_at = NULL, last_error = NULL",
        }[action]
        guard = "status = 3" if action == "replay" else "status NOT IN (1, 3)"
        return f"UPDATE {check_table_name(table)} SET {sets}, locked_by = NULL, locked_at = NULL WHERE event_id = ? AND {guard}"

    def purge(self, table: str, by_age: bool = False) -> str:
        check_table_name(table)
        old = "created_at < ?" if by_age else "status IN (1, 3) AND (done_at < ? OR (done_at IS NULL AND created_at < ?))"
        top = f"{old} ORDER BY created_at, event_id {self.first}"
        return f"DELETE FROM {table} WHERE {top}" if self.delete_limit else f"DELETE FROM {table} WHERE event_id IN (SELECT event_id FROM {table} WHERE {top})"


#: Fields of a command that each action's statement takes, in order.
MARKS = {"done": ("at",), "retry": ("next_at", "error"), "defer": ("next_at",), "dead": ("at", "error"), "replay": ("at",)}
DIALECTS: dict[str, Dialect] = {}


def register(dialect: Dialect) -> None:
    DIALECTS[dialect.name.lower()] = dialect


for _d in (
    Dialect("h2", ("jdbc:h2:",), small="TINYINT"),
    Dialect("derby", ("jdbc:derby:",), first="FETCH FIRST ? ROWS ONLY", spark_writes=False),
    Dialect("mysql", ("jdbc:mysql:", "jdbc:tidb:"), skip_locked=True, delete_limit=True, text="JSON", time="DATETIME(6)", small="TINYINT"),
    Dialect("postgresql", ("jdbc:postgresql:",), "CAST(? AS jsonb)", skip_locked=True, returning=True, text="JSONB", time="TIMESTAMPTZ"),
):
    register(_d)


def discover(group: str = "relayloom.dialects") -> list[str]:
    """Register the dialects that installed packages offer as entry points; their names."""
    found = [p.load() for p in importlib.metadata.entry_points(group=group)]
    for d in found:
        register(d)
    return [d.name for d in found]


def dialect_of(url: str) -> Dialect:
    """By the longest prefix of the URL, in any case."""
    found = [(len(p), d.name, d) for d in DIALECTS.values() for p in d.prefixes if (url or "").lower().startswith(p)]
    if not found:
        raise ValueError(f"no dialect for {url!r}")
    return max(found, key=lambda x: x[:2])[2]


def dialect(name: str) -> Dialect:
    if (name or "").lower() not in DIALECTS:
        raise ValueError(f"no dialect {name!r}")
    return DIALECTS[name.lower()]


def read(spark: SparkSession, url: str, table: str, partitions: int = 1, lower: str | None = None, upper: str | None = None, **options: str) -> DataFrame:
    """The table, read in ranges of created_at where bounds are given; filters go to the database."""
    out = spark.read.format("jdbc").options(url=url, dbtable=check_table_name(table), preferTimestampNTZ="true", **options)
    if partitions > 1:
        out = out.options(partitionColumn="created_at", lowerBound=lower, upperBound=upper, numPartitions=partitions)
    found = out.load()
    return found.toDF(*[c.lower() for c in found.columns])  # names come back in the database's case


def append(events: DataFrame, url: str, table: str, **options: str) -> None:
    """Insert in statements of 500 rows; PostgreSQL takes text for its JSON columns."""
    extra = {"stringtype": "unspecified"} if dialect_of(url).name == "postgresql" else {}
    events.write.format("jdbc").options(url=url, dbtable=check_table_name(table), batchsize=ROWS, **extra, **options).mode("append").save()


class Transaction:
    """Statements on one connection, with what to do after a commit or a rollback."""

    def __init__(self, connection, gateway):
        self.connection, self._gateway = connection, gateway
        self.after_commit: list[Callable[[], None]] = []
        self.after_rollback: list[Callable[[], None]] = []

    def _prepared(self, sql: str, values: Iterable):
        statement, java = self.connection.prepareStatement(sql), self._gateway.java.sql
        for k, v in enumerate(values, 1):
            if v is None:
                statement.setNull(k, statement.getParameterMetaData().getParameterType(k))
            elif isinstance(v, datetime):
                statement.setTimestamp(k, java.Timestamp.valueOf(v.strftime("%Y-%m-%d %H:%M:%S.%f")))
            elif isinstance(v, str):
                statement.setString(k, v)
            elif isinstance(v, int) and not isinstance(v, bool):
                statement.setLong(k, v) if abs(v) > 2**31 - 1 else statement.setInt(k, v)
            else:
                statement.setObject(k, v)
        return statement

    def update(self, sql: str, *values) -> int:
        """Rows that the statement changed."""
        statement = self._prepared(sql, values)
        try:
            return statement.executeUpdate()
        finally:
            statement.close()

    def query(self, sql: str, *values) -> list[dict]:
        """Rows by lower-case column name; a statement that changes rows may give them back, too."""
        statement = self._prepared(sql, values)
        try:
            rows = statement.executeQuery()
            head = rows.getMetaData()
            names = [head.getColumnLabel(k + 1).lower() for k in range(head.getColumnCount())]
            kinds = [head.getColumnType(k + 1) for k in range(len(names))]
            times = (self._gateway.java.sql.Types.TIMESTAMP, self._gateway.java.sql.Types.TIMESTAMP_WITH_TIMEZONE)
            whole = (self._gateway.java.sql.Types.SMALLINT, self._gateway.java.sql.Types.TINYINT, self._gateway.java.sql.Types.INTEGER, self._gateway.java.sql.Types.BIGINT)
            out = []
            while rows.next():
                row = {}
                for k, (name, kind) in enumerate(zip(names, kinds), 1):
                    if kind in times:
                        at = rows.getTimestamp(k)
                        row[name] = None if at is None else datetime.fromisoformat(at.toString())
                    elif kind in whole:
                        n = rows.getLong(k)
                        row[name] = None if rows.wasNull() else n
                    else:
                        row[name] = rows.getString(k)
                out.append(row)
            return out
        finally:
            statement.close()


class JdbcStore:
    """The event table in a database, with the operations of `EventStore`. Reads of many rows are Spark's; statements with limits run here."""

    def __init__(self, spark: SparkSession, url: str, name: str = "event_delivery", **options: str):
        self.spark, self.url, self.name, self.options, self.dialect = spark, url, check_table_name(name), options, dialect_of(url)

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Commits at the end, rolls back if it was left by an exception; callbacks run after either, and the connection is closed."""
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        tx = Transaction(connection, jvm)
        try:
            connection.setAutoCommit(False)
            try:
                yield tx
                connection.commit()
            except BaseException:
                connection.rollback()
                for each in tx.after_rollback:
                    each()
                raise
            for each in tx.after_commit:
                each()
        finally:
            connection.close()

    def create(self) -> None:
        with self.transaction() as tx:
            for statement in self.dialect.create(self.name).split("; "):
                tx.update(statement)

    def read(self) -> DataFrame:
        return read(self.spark, self.url, self.name, **self.options).select(*[F.col(c).cast(EVENTS[c].dataType) for c in COLUMNS])

    def _frame(self, rows: list[dict]) -> DataFrame:
        schema = self.spark.createDataFrame([], EVENTS).select(*POLLED).schema
        return self.spark.createDataFrame([tuple(r[c] for c in POLLED) for r in rows], schema)

    def insert_rows(self, tx: Transaction, rows: Iterable) -> int:
        """Rows with the table's columns, in statements of up to 500, on the caller's transaction."""
        n = 0
        for some in batched(rows, ROWS):
            n += tx.update(self.dialect.insert(self.name, len(some)), *(r[c] for r in some for c in COLUMNS))
        return n

    def insert(self, events: DataFrame) -> None:
        """Add rows. Each partition is a transaction of its own, or, where Spark can't write, each 500 rows."""
        if not self.dialect.spark_writes:
            for some in batched((r.asDict() for r in events.select(*COLUMNS).toLocalIterator()), ROWS):
                with self.transaction() as tx:
                    self.insert_rows(tx, some)
            return
        append(events.select(*COLUMNS), self.url, self.name, **self.options)

    def stage(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows as evaluated once: made ids don't vary after that."""
        rows = events.select(*COLUMNS).checkpoint()
        return rows, rows

    def commit(self, staged: DataFrame, stream: tuple[str, int] | None = None) -> bool:
        """Staged rows into the table. A stream's batch that is run again is known by its ids."""
        if stream is not None:
            staged = staged.join(self.read().select("event_id"), "event_id", "left_anti")
        self.insert(staged)
        return True

    def poll(self, now: datetime, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
        with self.transaction() as tx:
            return self._frame(tx.query(self.dialect.poll(self.name), now, now - (skip_recent or timedelta(0)), max(limit, 0)))

    def claim(self, owner: str, now: datetime, lock_expiry: datetime, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
        """One transaction; where the database skips locked rows, nodes don't wait for each other."""
        free = now, now - (skip_recent or timedelta(0)), lock_expiry, max(limit, 0)
        first, *second = self.dialect.claim(self.name)
        with self.transaction() as tx:
            if self.dialect.returning:
                rows = tx.query(first, *free, owner, now)
            elif self.dialect.skip_locked:
                rows = tx.query(first, *free)
                for some in batched([r["event_id"] for r in rows], ROWS):
                    tx.update(second[0] % ", ".join("?" * len(some)), owner, now, *some)
            else:
                tx.update(first, owner, now, *free)
                rows = tx.query(second[0], owner, now)
        return self._frame(sorted(rows, key=lambda r: (r["created_at"], r["event_id"])))

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.read().join(F.broadcast(ids.limit(ROWS)), "event_id", "left_semi") if ids.count() <= ROWS else self.read().join(ids, "event_id", "left_semi")

    def apply(self, commands: DataFrame) -> int:
        """Commands in their order, a transaction for each 500; rows changed. They come to the driver a partition at a time."""
        n = 0
        for some in batched(commands.orderBy("event_id", "seq").toLocalIterator(), ROWS):
            with self.transaction() as tx:
                for c in some:
                    n += self._mark(tx, c.event_id, c.action, c.asDict())
        return n

    def _mark(self, tx: Transaction, event_id: str, action: str, values: dict) -> int:
        given = [transitions.cut(values[k]) if k == "error" else values[k] for k in MARKS[action]]
        return tx.update(self.dialect.mark(self.name, action), *given, event_id)

    def query_dead(self, limit: int, event_type: str | None = None, aggregate_type: str | None = None) -> DataFrame:
        given = [x for x in (event_type, aggregate_type) if x is not None]
        with self.transaction() as tx:
            return self._frame(tx.query(self.dialect.dead(self.name, event_type is not None, aggregate_type is not None), *given, max(limit, 0)))

    def count_dead(self, event_type: str | None = None) -> int:
        with self.transaction() as tx:
            return tx.query(self.dialect.dead(self.name, event_type is not None, False, True), *[x for x in (event_type,) if x is not None])[0]["n"]

    def replay(self, event_id: str, now: datetime) -> bool:
        with self.transaction() as tx:
            return self._mark(tx, event_id, "replay", {"at": now}) == 1

    def replay_all(self, now: datetime, event_type: str | None = None, aggregate_type: str | None = None, batch: int = 100) -> int:
        """Batch by batch until one is short or changes nothing."""
        if batch <= 0:
            raise ValueError("batch must be positive")
        total = 0
        while True:
            ids = [r.event_id for r in self.query_dead(batch, event_type, aggregate_type).collect()]
            with self.transaction() as tx:
                done = sum(self._mark(tx, i, "replay", {"at": now}) for i in ids)
            total += done
            if len(ids) < batch or not done:
                return total

    def purge(self, cutoff: datetime, limit: int | None = 500, by_age: bool = False) -> int:
        """Rows deleted: one batch, or batches until one is short if limit is None."""
        size, total = ROWS if limit is None else max(limit, 0), 0
        while True:
            with self.transaction() as tx:
                n = tx.update(self.dialect.purge(self.name, by_age), *[cutoff] * (1 if by_age else 2), size)
            total += n
            if limit is not None or n < size:
                return total
