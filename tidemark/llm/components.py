"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of every node to the smallest of them and the node."""
    if larger:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    own = least.where("m <> a").select("a", F.col("m").alias("b"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Return (node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round is a table in the shared folder, so a lost executor costs one
    round at most. The rounds end when the edges are a set of stars.
    """
    state = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        new = stored(_star(_star(state, True), False), "edges")
        drop(state)
        state = new
        sums = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
