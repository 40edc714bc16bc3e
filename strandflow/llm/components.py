"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours meet the smallest node of its neighbourhood instead of the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours meet the smallest of them; edges come as (greater, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.withColumnRenamed("m", "b").unionByName(others).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component): component is the smallest node reachable.

    Large stars and small stars alternate (Kiveris et al.) until every node hangs on its smallest
    one, so rounds grow with the logarithm of the size and no number of rounds is too many; the
    edges never become more. They are written to the shared folder each time. Self loops and null
    ends are ignored; nodes without edges do not appear.
    """
    e = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = materialize(_large_star(e), "large-star")
        small = materialize(_small_star(large), "small-star")
        done_with(e, large)
        e = small
        roots = e.select(F.col("b").alias("a")).distinct()
        # done when each node has one edge and no root hangs on another
        if e.groupBy("a").count().filter("count > 1").isEmpty() and e.join(roots, "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
