"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceworks.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): for every node of an edge, the least node it is connected with.

    Node ids are longs; null ends, loops and repeated edges are ignored. Least neighbours come from partial minima
    and are joined back, so a node with very many edges is no single task's work. Each round is written to the
    shared folder.
    """
    edges = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct(), "edges")
    state = _state(edges)
    while True:
        after = written(_small_star(_large_star(edges)), "edges")
        drop_written(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
