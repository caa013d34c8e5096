"""Connected components of an edge table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, label): equal labels for connected nodes; nodes without an edge are absent.

    In each round every node joins its neighbour of least random priority, if that is less than its own, and edges are
    carried over to what was joined, until none is left: the expected number of rounds grows with the logarithm of the
    number of nodes, whatever their order. Rounds end in tables of the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a")).getField("v").alias("up"))
        up = cut(up, "joined")
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = cut(labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges, turn = cut(moved, "edges"), turn + 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
