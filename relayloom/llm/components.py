"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import checkpoint_dir


def _stars(edges: DataFrame) -> DataFrame:
    """Large star: each node's larger neighbours are linked to its smallest one (itself included)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _hubs(edges: DataFrame) -> DataFrame:
    """Small star: here `a` is the larger end; its smaller neighbours and itself go to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the links (a, b), the smallest node it can reach.

    Links never come to the driver: each round is checkpointed (lost executors cost no earlier
    round) and only its row count and hash total are compared with those of the round before.
    Long chains shorten by a constant factor a round, so 60 rounds are far more than any table needs; if links had not settled then, it
    raises rather than give a part. Loops and null ends are dropped; an empty
    table gives an empty result. A hub's rows meet in joins, whose skewed partitions Spark splits.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    total = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == total:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct())
        total = now
        if not now[0]:
            break
        edges = _hubs(_stars(edges)).checkpoint()
    else:
        raise RuntimeError(f"links have not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
