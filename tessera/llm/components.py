"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b): every node's neighbours are tied to the smallest of them and itself.

    The minimum is a partial aggregate and is joined back, so a hub's edges never lie in one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id and component (the smallest id reachable) of every node of `edges` (columns a, b); nulls are left out.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path."""
    now = materialize(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    stamp = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == stamp or not mark[0]:
            break
        stamp = mark
        now = materialize(_star(_star(now, True), False), label)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
