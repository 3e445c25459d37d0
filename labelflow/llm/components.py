"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import discard, materialise, spread_join


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges and result have a > b. The least neighbour comes from an aggregate
    and a join that deals a hub's neighbours over many tasks."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = spread_join(both.where("b > a"), least, ["a"], ["b"]).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    large = materialise(large, "large")
    lower = large.groupBy("a").agg(F.min("b").alias("m"))
    out = spread_join(large, lower, ["a"], ["b"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
    out = materialise(out, "stars")
    discard(large)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): each node of edges (a, b) with the least node that it can reach. Loops and repeated edges do
    no harm; edges with a null count as none; without edges there are no rows. Each round is written to the shared
    folder and the one before it deleted. Both steps never lengthen a path, and together they take a number of rounds
    that grows with the logarithm of the nodes (twice its square is the proven bound)."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = mark(now)
    while state[0]:
        last, now = now, _starred(now)
        discard(last)
        state, before = mark(now), state
        if state == before:
            break
    # In a star every node points at the least one.
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._shared_path = now._shared_path
    return out
