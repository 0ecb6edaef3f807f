"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Each step replaces links by links to smaller neighbours, without changing what is
    connected, until every node hangs on the smallest of its component. Only counts and a
    checksum reach the driver. The number of links never grows; the minimum of a hot node
    is pre-aggregated, and its join is one that adaptive execution can split.
    """
    ab = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = scratch.write(ab)
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if not seen["n"] or seen == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
        before = seen
        # Large star: every larger neighbour of v is linked to the smallest of v and its neighbours.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: v and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b"))
        new = scratch.write(small.where("a < b").distinct())
        scratch.drop(now)
        now = new
