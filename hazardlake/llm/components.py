"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _towards_least(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours become neighbours of its least one."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _among_smaller(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours become neighbours of the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); a component is named by its least node.

    Two steps alternate until the edges are stars around least nodes, which takes about as many
    rounds as the logarithm of the number of nodes. Each keeps the components and never makes
    more edges than it has read; a node's edges are only aggregated and joined, never collected.
    Edges with NULL and loops are left out.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    state = None
    while True:
        now = stored(_among_smaller(_towards_least(now)))
        found = now.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select("b", "b").distinct())
