"""Listeners by (aggregate type, event type), as a table joined with events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from relayloom.schema import GLOBAL, type_name

SCHEMA = "aggregate_type string, event_type string, listener string"
#: Routes are written in code; beyond this many they are joined without a broadcast hint.
BROADCAST_ROUTES = 100_000


@dataclass
class Routes:
    """A registry: at most one listener to a pair."""

    pairs: dict[tuple[str, str], str] = field(default_factory=dict)

    def add(self, listener: str, event_type: object, aggregate_type: object = GLOBAL) -> Routes:
        if listener is None:
            raise ValueError("a route needs a listener")
        key = type_name(aggregate_type), type_name(event_type)
        if key in self.pairs:
            raise ValueError(f"a second listener for {key}")
        self.pairs[key] = listener
        return self

    def listener_for(self, aggregate_type: str | None, event_type: str) -> str | None:
        return self.pairs.get((aggregate_type or GLOBAL, event_type))

    def frame(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame([(*k, v) for k, v in self.pairs.items()], SCHEMA)
        return F.broadcast(out) if len(self.pairs) <= BROADCAST_ROUTES else out


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with their listener, null where none is registered. Both parts must match exactly; a missing
    aggregate type is the global one, and there is no fallback to it."""
    keyed = events.withColumn("__a", F.coalesce("aggregate_type", F.lit(GLOBAL)))
    own = routes.select(F.col("aggregate_type").alias("__a"), "event_type", "listener")
    return keyed.join(own, ["__a", "event_type"], "left").select(*events.columns, "listener")


def unroutable(events: DataFrame, routes: DataFrame) -> DataFrame:
    keyed = events.withColumn("__a", F.coalesce("aggregate_type", F.lit(GLOBAL)))
    own = routes.select(F.col("aggregate_type").alias("__a"), "event_type")
    return keyed.join(own, ["__a", "event_type"], "left_anti").select(*events.columns)


def duplicates(routes: DataFrame) -> DataFrame:
    """Pairs with more than one listener."""
    return routes.groupBy("aggregate_type", "event_type").agg(F.count("*").alias("n_listeners")).where("n_listeners > 1")
