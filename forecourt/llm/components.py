"""Connected components of links between numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every linked node.

    ``links`` has long columns a and b.  Each round hangs larger neighbours on the
    smallest one (large star), then smaller ones too (small star), until nothing moves;
    the number of rounds grows with the logarithm of the longest path.  Every half round
    is a written table, so a lost executor costs one half round, and the joins read plain
    tables, which lets Spark split a root that holds a large share of the nodes.
    """
    edges = stage(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = (both.join(least, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stage(large.where("a <> b"), "large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        edges = stage(small.where("a <> b").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
