"""Connected components by alternating stars, with the edges written out between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hallkeeper.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them: the larger neighbours, or the smaller ones."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        linked = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.filter("a != b").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether each node that points elsewhere points to one node, which itself points nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select(F.col("b"), F.lit(0), F.lit(1))
    )
    counts = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return counts.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); the root is the component's smallest node."""
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.distinct())
    while not _is_done(edges):
        edges = cut_lineage(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
