"""Connected components of an edge table, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import shared

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps; each links a neighbourhood to its
    smallest node, so hot nodes only ever take part in aggregations with map-side
    combining and in joins. Rounds are logarithmic in a component's size; every round's
    table is written to the shared folder. No edges give no rows; loops are ignored.
    """
    current = shared.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    spark = edges.sparkSession
    if current.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself).
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: a node's smaller neighbours go to the smallest of them.
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("n"), F.col("a").alias("s")).join(low, "n")
        after = small.select(F.col("m").alias("a"), F.explode(F.array("n", "s")).alias("b")).filter("a < b").distinct()
        after = shared.stored(after, "edges")
        # Done when the edges are stars: no centre is a leaf, and no leaf has two centres.
        leaves = after.groupBy("b").agg(F.count("*").alias("n"))
        done = leaves.filter("n > 1").isEmpty() and after.join(leaves.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        current = after
        if done:
            break
    else:
        raise RuntimeError(f"components: no stars after {MAX_ROUNDS} rounds")
    stars = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
