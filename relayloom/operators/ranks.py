"""Places of rows in an order, within groups or over all rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F, types as T

from relayloom.schema import ORDER


def numbered(events: DataFrame, by: Iterable[str] = ORDER, within: str | None = None) -> DataFrame:
    """events with `rank` (0, 1, ...) in the order of `by` within a column; over all rows, `ranked`."""
    if within is None:
        return ranked(events, by)
    window = Window.partitionBy(within).orderBy(*by)
    return events.withColumn("rank", F.row_number().over(window) - 1)


def ranked(events: DataFrame, by: Iterable[str] = ORDER) -> DataFrame:
    """events with `rank` (0, 1, ...) in the order of `by` over all rows: sorted by range, each range counted, so
    that no task holds more than its share."""
    schema = T.StructType([*events.schema.fields, T.StructField("rank", T.LongType())])
    rows = events.orderBy(*by).rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return events.sparkSession.createDataFrame(rows, schema, verifySchema=False)
