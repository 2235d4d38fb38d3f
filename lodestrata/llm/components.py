"""Connected components of an edge table, without a driver-side graph: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_least_neighbour(both), F.col("u") == F.col("c")).where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them. Edges point to smaller nodes."""
    least = _least_neighbour(edges)
    out = edges.join(least, F.col("u") == F.col("c")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: common.Scratch, rounds: int | None = None) -> DataFrame:
    """Of (a, b), both long: node and root, the smallest node of its component, for every node with an edge.

    With ``rounds`` it stops after so many; a root then is some node of the component, which may have several.
    Each round writes the edges to the shared folder and deletes those of the round before; the result is a table of
    ``scratch``. Rounds grow with the logarithm of the longest chain.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.table(now, "edges")
    seen, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if sums == seen or not sums[0]:
            break
        seen, last = sums, now
        now = scratch.table(_small_star(_large_star(now)), "edges")
        scratch.drop(last)
    # of several roots that are left to a node the smallest; a root that has one itself keeps it
    both = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v"))
    out = scratch.table(both.groupBy("node").agg(F.min("root").alias("root")), "roots")
    scratch.drop(now)
    return out
