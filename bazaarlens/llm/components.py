"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.staging import staged


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, component`` for every node with an edge to another node; the component is
    its smallest node.

    Edges are kept from the larger to the smaller node. A round hangs each edge's large
    end onto the smallest node below its small end, then replaces a node's edges by one to
    its smallest neighbour and edges from the other neighbours to that one. Components
    stay what they were and trees halve in height, so the number of rounds is about the
    logarithm of the longest path. Each round is written, so that lineage does not grow.
    Rounds end once every node has one edge and no edge ends where another begins; edges
    that are stars around their smallest nodes from the start need no round at all. Null
    ends and loops are left out.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = staged(e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    while True:
        below = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        moved = e.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        moved = staged(moved, "edges-moved")
        low = staged(moved.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved")), "edges-low")
        if not low.where((F.col("n") > 1) | F.col("moved")).limit(1).count():
            break
        others = moved.join(low.select("u", "m"), "u").where(F.col("v") != F.col("m"))
        others = others.select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(others.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
