"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root being the smallest node it reaches.

    Each round hangs neighbours on smaller neighbours and stops when the table no longer changes, after
    about log(longest path) rounds. Rounds are written to the shared folder, so nothing is recomputed after
    a loss. Minima are pre-aggregated; the joins that send them back have plain exchanges on both
    sides, so adaptive execution can split a node with very many neighbours. Loops and repeated edges are
    ignored; no edges give an empty table.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = save(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        own = save(large.groupBy("a").agg(F.min("b").alias("m")), "own")
        moved = large.join(own, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = save(moved.union(own.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
