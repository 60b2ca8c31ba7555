"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.session import written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)``: rows ``(node, component)``, the
    component being its smallest node.

    Large-star and small-star steps: every node is joined to the least node of
    its neighbourhood.  Minima are partial aggregates and the joins are on
    nodes, so a node with many edges is split like any skewed key.  Each step is
    written; steps go on until the edges are stars, after a number of steps that
    grows with the logarithm of a component's size.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "links")
    before = None
    while True:
        # Large star: larger neighbours of each node go to the least one around it.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large = written(large, "links-large")
        # Small star: smaller neighbours, and the node itself, go to the least one.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(
            least.select("a", F.col("_m").alias("b"))).where("a <> b").distinct()
        edges = written(small, "links-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
