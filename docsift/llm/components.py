"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.shared import Tables


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Each round hangs every neighbour of a node under the least of them, first the larger
    ones, then the smaller ones; the number of rounds grows as the logarithm of the
    longest path. Edges never leave the executors; each round is a written table.
    """
    edges = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = tables.write(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")))
        down = large.join(least, "a")
        fresh = tables.write(down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        tables.drop(edges, large)
        edges = fresh
    # now every edge leads from a node to its root
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
