"""Connected components of a large graph, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.sizing import settled


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v. Large: every larger neighbour of u is tied to u's least one. Small: every smaller neighbour, and u, is."""
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges``: u, v, longs, in any order. Returns (u, root) for every vertex but the roots; a root is its component's least vertex.

    Each round writes its edges to the shared folder, so lineage stays short; rounds grow with the logarithm of the longest path. A vertex
    with very many neighbours is only ever summed (partially first) and joined, which adaptive execution splits.
    """
    held = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    seen = None
    while True:
        held = settled(_stars(_stars(held, True), False), label)
        mark = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return held.withColumnRenamed("v", "root")
        seen = tuple(mark)
