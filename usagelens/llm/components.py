"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its least node.

    Each round links larger neighbours to the least neighbour, then smaller ones, until
    every node hangs at the least of its component. A node with very many edges is one
    row on the side that is aggregated and written, so the join on it is split. All
    joins are by sort and merge, since their tables grow with the links and their files
    tell little of the memory that a broadcast would take on the driver.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    state = _state(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first())
