"""Connected components by alternating large-star and small-star steps on DataFrames.

Cases: an edge from a node to itself and repeated edges count for nothing; an edge with a null end is left
out; no edges give no rows. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import join_hot, settled, stage


def _flat(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: no node has two edges, and no end of one is the start of another."""
    ends = edges.select("a", F.lit(1).alias("_s")).unionAll(edges.select(F.col("b").alias("a"), F.lit(0).alias("_s")))
    return ends.groupBy("a").agg(F.sum("_s").alias("_s"), F.count("*").alias("_n")).filter("_s > 1 or (_s = 1 and _n > 1)").isEmpty()


@settled
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: pairs of ids. Returns node, root for every node of an edge but those that only meet themselves; root is the smallest id reachable.

    Each step reads and writes a staged table; nothing but a count and whether it is done reaches the driver. A node's
    smallest neighbour is found by partial aggregation, and the neighbours of a hub are dealt over
    several tasks, so that a star with millions of leaves is no single task's work."""
    whole = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    ordered = whole.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = stage(ordered.distinct(), "cc")
    while not _flat(now):
        n = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("a", "m"))
        large = join_hot(both.filter("b > a"), least, "a", "_n", 2 * n, "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        # Neighbours above the smallest point to it as well.
        rest = join_hot(large, small, "a", "_n", n, "b").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.select("a", F.col("m").alias("b")).unionByName(rest).distinct(), "cc")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
