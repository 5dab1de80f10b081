"""The event table on files, which have no row updates: layers of rows, and a log of commits.

An insert writes a layer of new rows. A change writes a layer of the rows it changed, whole, and marks those it deletes;
so either writes in proportion to its batch, whatever the size of the table. A read takes the newest row of each
changed event, and the inserted rows of all others: filters reach the scans of both, and the ids to leave out are broadcast
while there are few. When changed rows come to a quarter of the table, both are written anew as one
layer, by status, so that polls skip closed events; a row is rewritten a bounded number of times as the table grows by its own size.

A commit is a file named by its number that lists the layers. Its name can be taken once: of two writers that began at the
same commit one fails, and evaluates its change again on what the other left. So claims of different owners are disjoint, and no change
is lost. Readers keep the commit they began with. The log needs a file system on which a file is not renamed onto another (HDFS), or a
local one.
"""

from __future__ import annotations

import functools
import json
import os
import random
import time
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from relayloom.operators import purge, scans, transitions
from relayloom.schema import COLUMNS, EVENTS, ORDER, Status, check_table_name

#: A layer of changes, with its own name as Spark finds it in the path.
CHANGES = T.StructType([*EVENTS.fields, T.StructField("deleted", T.BooleanType()), T.StructField("layer", T.StringType())])
IDS = T.StructType(EVENTS.fields[:1])
#: Ids of changed rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Layers of a kind before they are merged, and changed rows for each row of the table before all is written anew.
LAYERS, SHARE, LEAST = 16, 0.25, 10_000
#: Up to so many ids become a filter that the scan can use; more are joined.
FILTER_IDS = 1_000


class Conflict(Exception):
    """Another writer took the number of this commit."""


class EventStore:
    def __init__(self, spark: SparkSession, folder: str, name: str = "event_delivery"):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{check_table_name(name)}"

    # Files

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.globStatus(path(f"{self.folder}/commits/[0-9]*")) or [])

    def state(self) -> dict:
        """The last commit: its number, layers [name, rows] of inserted rows and of changes (oldest first), and the last batch of each stream."""
        names = self._commits()
        if not names:
            return {"number": -1, "rows": [], "changes": [], "streams": {}}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.folder}/commits/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """Write a commit under the number after the one it was made from, or raise Conflict."""
        fs, path = self._fs()
        state = state | {"number": state["number"] + 1}
        made, name = f"{self.folder}/commits/.{uuid.uuid4().hex}", f"{self.folder}/commits/{state['number']:012d}"
        out = fs.create(path(made), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a local rename would replace the other's commit; a second link to a name fails
                os.link(path(made).toUri().getPath(), path(name).toUri().getPath())
            elif not fs.rename(path(made), path(name)):
                raise FileExistsError
        except FileExistsError as e:
            raise Conflict(name) from e
        finally:
            fs.delete(path(made), False)

    def _write(self, kind: str, events: DataFrame, by_status: bool = True) -> list[tuple[str, int]]:
        """A layer as written once: what varies by evaluation is fixed by it. None for no rows."""
        name, seen = uuid.uuid4().hex, Observation()
        writer = events.observe(seen, F.count(F.lit(1)).alias("n")).write
        (writer.partitionBy("status") if by_status else writer).parquet(f"{self.folder}/{kind}/layer={name}")
        return [(name, seen.get["n"])] if seen.get["n"] else []

    def _layers(self, kind: str, layers: list, schema) -> DataFrame:
        if not layers:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{kind}/layer={name}" for name, _ in layers]
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)
        return found.select(*schema.names)

    # Reading

    def _changed(self, state: dict) -> DataFrame:
        """The newest row of each changed event, and whether it is deleted."""
        rows = self._layers("changes", state["changes"], CHANGES)
        if len(state["changes"]) < 2:
            return rows.drop("layer")
        age = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(state["changes"]) for x in (name, k)])
        newest = Window.partitionBy("event_id").orderBy(F.col("__age").desc())
        return rows.withColumn("__age", age[F.col("layer")]).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("layer", "__age", "__n")

    def read(self, state: dict | None = None) -> DataFrame:
        state = self.state() if state is None else state
        rows = self._layers("rows", state["rows"], EVENTS)
        if not state["changes"]:
            return rows
        changed = self._changed(state)
        ids = self._layers("changes", state["changes"], IDS)
        if sum(n for _, n in state["changes"]) <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return rows.join(ids, "event_id", "left_anti").select(*COLUMNS).unionByName(changed.where("not deleted").select(*COLUMNS))

    def _of(self, events: DataFrame, ids: DataFrame) -> DataFrame:
        """Events of some ids. A few become a filter, by which a scan skips row groups."""
        few = [r.event_id for r in ids.select("event_id").distinct().limit(FILTER_IDS + 1).collect()]
        if len(few) <= FILTER_IDS:
            return events.where(F.col("event_id").isin(few)) if few else events.limit(0)
        return events.join(ids.select("event_id").distinct(), "event_id", "left_semi")

    # Writing

    def _retry(self, step: Callable[[dict], object]):
        """step on the last commit, and again on the next one if another writer was faster."""
        for attempt in range(100):
            try:
                return step(self.state())
            except Conflict:
                time.sleep(random.random() * min(2.0, 0.01 * 2**attempt))
        raise Conflict("a hundred times in a row")

    def stage(self, events: DataFrame) -> tuple[DataFrame, list]:
        """The rows as written once, not yet part of the table, and their layer."""
        layer = self._write("rows", events.select(*COLUMNS))
        return self._layers("rows", layer, EVENTS), layer

    def commit(self, layer: list, stream: tuple[str, int] | None = None) -> bool:
        """Make staged rows part of the table; with a stream's name and batch number, only if that batch has not been."""

        def step(state: dict) -> bool:
            if stream is not None and state["streams"].get(stream[0], -1) >= stream[1]:
                return False
            streams = state["streams"] | ({} if stream is None else {stream[0]: stream[1]})
            self._publish(state | {"rows": state["rows"] + layer, "streams": streams})
            return True

        done = self._retry(step) if layer or stream else True
        self._tidy()
        return done

    def insert(self, events: DataFrame) -> None:
        """Add rows with new ids."""
        self.commit(self._write("rows", events.select(*COLUMNS)))

    def change(self, make: Callable[[DataFrame], DataFrame], deleted: bool = False) -> DataFrame:
        """Put what `make` gives of the table in the place of its rows with the same ids, or take those out; these rows."""

        def step(state: dict) -> DataFrame:
            made = make(self.read(state)).select(*COLUMNS).withColumn("deleted", F.lit(deleted))
            if deleted:  # only the id counts
                made = made.withColumns({"payload": F.lit(""), "headers": F.lit(None).cast("string")})
            layer = self._write("changes", made)
            if layer:
                try:
                    self._publish(state | {"changes": state["changes"] + layer})
                except Conflict:
                    self._delete(f"{self.folder}/changes/layer={layer[0][0]}")
                    raise
            return self._layers("changes", layer, EVENTS)

        rows = self._retry(step)
        self._tidy()
        return rows

    def _tidy(self) -> None:
        """Write anew what has become too many layers, or too many changes; if another writer comes first, it may do so."""
        state = self.state()
        changed, rows = (sum(n for _, n in state[k]) for k in ("changes", "rows"))
        try:
            if changed > max(LEAST, SHARE * rows):
                self.compact()
            elif len(state["changes"]) > LAYERS:
                layer = self._write("changes", self._changed(state))
                self._publish(state | {"changes": layer})
            elif len(state["rows"]) > LAYERS:
                # The smallest half, so that a large layer is seldom written again.
                small = sorted(state["rows"], key=lambda x: x[1])[: len(state["rows"]) // 2 + 1]
                layer = self._write("rows", self._layers("rows", small, EVENTS).select(*COLUMNS))
                self._publish(state | {"rows": [x for x in state["rows"] if x not in small] + layer})
        except Conflict:
            pass

    def compact(self) -> None:
        """All rows as one layer without changes, sorted by time within files, so that scans can skip parts of these."""
        state = self.state()
        layer = self._write("rows", self.read(state).sortWithinPartitions("status", *ORDER))
        self._publish(state | {"rows": layer, "changes": []})

    def _delete(self, where: str) -> None:
        fs, path = self._fs()
        fs.delete(path(where), True)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last commits, and layers of none of these; no reader or writer may be on them."""
        fs, path = self._fs()
        names = self._commits()
        kept = set()
        for name in names[-keep:]:
            stream = fs.open(path(f"{self.folder}/commits/{name}"))
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            kept |= {f"{kind}/layer={x}" for kind in ("rows", "changes") for x, _ in state[kind]}
        for name in names[:-keep]:
            self._delete(f"{self.folder}/commits/{name}")
        for kind in ("rows", "changes"):
            for s in fs.globStatus(path(f"{self.folder}/{kind}/layer=*")) or []:
                if f"{kind}/{s.getPath().getName()}" not in kept:
                    fs.delete(s.getPath(), True)

    # The table's operations

    def apply(self, commands: DataFrame) -> DataFrame:
        """Fold commands into their events; the rows that changed. Commands are evaluated more than once if writers meet, so they
        are to be fixed (as collected or stored rows are)."""
        return self.change(lambda events: transitions.transition(self._of(events, commands), commands).where("applied > 0"))

    def poll(self, now, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
        return scans.poll_pending(self.read(), now, limit, skip_recent)

    def claim(self, owner: str, now, lock_expiry, limit: int, skip_recent: timedelta | None = None) -> DataFrame:
        """Lock the oldest free events for owner, and hand them on: only their rows are written and read back."""
        locked = self.change(functools.partial(scans.claim_rows, owner=owner, now=now, lock_expiry=lock_expiry, limit=limit, skip_recent=skip_recent))
        return scans.select_claimed(locked, owner, now)

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self._of(self.read(), ids)

    def query_dead(self, limit: int, event_type: str | None = None, aggregate_type: str | None = None) -> DataFrame:
        return scans.query_dead(self.read(), limit, event_type, aggregate_type)

    def count_dead(self, event_type: str | None = None) -> int:
        return scans.count_dead(self.read(), event_type).first().n_dead

    def replay(self, event_id: str, now) -> bool:
        """Whether the event was dead, and so is new again."""
        one = lambda events: scans.by_id(events, event_id).where(F.col("status") == int(Status.DEAD))
        return not self.change(lambda events: transitions.replay_all(one(events), now)).isEmpty()

    def replay_all(self, now, event_type: str | None = None, aggregate_type: str | None = None, batch: int = 100) -> int:
        return self.change(lambda events: transitions.replay_all(scans.dead(events, event_type, aggregate_type), now, batch=batch)).count()

    def purge(self, cutoff, limit: int | None = 500, by_age: bool = False) -> int:
        """Rows deleted: one batch, or everything if limit is None."""
        rule = (purge.made_before if by_age else purge.ended_before)(cutoff)
        old = lambda events: events.where(rule) if limit is None else events.where(rule).orderBy(*ORDER).limit(max(limit, 0))
        return self.change(old, deleted=True).count()
