"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._join import answered
from ._store import release, stored


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("__m"), F.count(F.lit(1)).alias("copies")).select(F.col("a").alias("__a"), F.least("a", "__m").alias("__m"), "copies")
    least = stored(least, "least")
    return answered(both.filter("b > a"), least, {"a": "__a"}, how="inner").select(F.col("__m").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = stored(edges.groupBy("b").agg(F.min("a").alias("__m"), F.count(F.lit(1)).alias("copies")), "least")
    moved = answered(edges, least.withColumnRenamed("b", "__b"), {"b": "__b"}, how="inner").select(F.col("__m").alias("a"), F.col("a").alias("b"))
    return moved.filter("a != b").union(least.select(F.col("__m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every node of edges (a, b): comp is the smallest node that it reaches.

    Large and small stars in turn, until each component is a star around its
    smallest node. A step needs two sums by node and never gathers a node's
    neighbours: edges of nodes with very many stay where they are. Steps are
    about the logarithm of the longest path. Loops and repeated edges count as
    none.
    """
    edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        last, large = edges, stored(_large(edges), "edges")
        edges = stored(_small(large), "edges")
        release(last, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("b").alias("cls"), F.col("a").alias("comp"))
    return nodes.union(edges.select(F.col("a").alias("cls"), F.col("a").alias("comp")).distinct())
