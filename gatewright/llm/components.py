"""Connected components by alternating stars, in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a long, b long): root is the least node that can be reached.

    Large stars hang a node's larger neighbours on the least, small stars its
    smaller ones, until nothing changes; rounds grow with the logarithm of the
    longest path. Minima are partial aggregates and are written before they are
    joined, so a hub's edges can be split over tasks.
    """
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    state, old = None, []
    for i in range(1, most + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-{i}-large")
        large = scratch.table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-{i}-star")
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{i}-small")
        hung = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = scratch.table(hung.where("a <> b").distinct(), f"{name}-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(*old)
        old = [f"{name}-{i - 1}", *(f"{name}-{i}-{k}" for k in ("large", "star", "small"))]
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    scratch.drop(*old)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return scratch.table(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), name)
