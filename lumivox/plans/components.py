"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.plans.joins import split_join
from lumivox.plans.scratch import written_with


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return split_join(both.where("b > a"), least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(edges, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge: the smallest node reachable from it.

    Edges are undirected; repeated edges and loops do no harm, edges with a null end are ignored.
    A node that appears in loops only is its own component. Each round is a few shuffles of the edges and is
    written to the shared folder, and rounds grow with the logarithm of the longest path. No node's
    neighbours are gathered: minima are pre-aggregated and joined back, with exchanges on both sides, so a hub's edges are split.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = pairs.where("u = v").select("u").distinct()
    size = (F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    current, seen = written_with(pairs.where("u <> v").distinct(), "edges", *size)
    before = None
    while seen["n"] and seen != before:
        before = seen
        current, seen = written_with(_small_star(_large_star(current)), "edges", *size)
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
