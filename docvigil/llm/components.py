"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import materialize
from docvigil.operators.fixpoint import forget


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of long ids to (node, component): the smallest id that a node reaches.

    Nodes without an edge (or with an edge to themselves only) have no row. Each round is two joins
    and is written to the shared folder; rounds end when no edge changes, after a number that is
    logarithmic in a component's width.
    Duplicate and reversed edges are harmless.
    """
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: each larger neighbour of u goes to the least of u and its neighbours
        near = _both(edges)
        low = materialize(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        forget(edges, low)
        # small star: u and its smaller neighbours go to the least of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        edges = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(edges, "edges")
        forget(large, low)
        now = tuple(edges.agg(F.count("u"), F.sum("v").cast("string"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
