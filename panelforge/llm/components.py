"""Connected components of an edge list, by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint


#: Edges for a partition, of which there are FEWEST at least.
EDGES, FEWEST = 100_000, 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): class is the smallest node of the component; nodes without edges don't occur.

    Each round hangs every node's larger neighbours on the smallest one (large star),
    then every node and its smaller neighbours on the smallest (small star); rounds
    go on until nothing changes, which takes about the logarithm of a component's
    diameter.  A hot node's edges are reduced by partial aggregation and joined with
    one row, which adaptive execution can split.  Each round is checkpointed.  Partitions
    are merged, without a shuffle, to as many as the edges need.
    """
    now = checkpoint(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    parts = max(FEWEST, now.count() // EDGES)
    now, before = now.coalesce(parts), None
    while True:
        both = now.union(now.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").coalesce(parts)
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).coalesce(parts)
        hung = large.join(low, large["hi"] == low["u"])
        small = hung.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo")
        now = checkpoint(small.coalesce(parts).distinct().coalesce(parts))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("class")).union(now.select(F.col("lo"), F.col("lo"))).distinct()
        before = state
