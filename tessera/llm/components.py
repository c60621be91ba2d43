"""Connected components of an edge table by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its component.

    Every round points nodes to a smaller one; a star of each component is left
    after a number of rounds that grows with the logarithm of its size. Each round
    is written, the one before is deleted, and only sums go to the driver. Edges of a node to
    itself are left out.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def summary(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, seen = None, summary(now)
    while seen != before:
        pairs = both(now)
        # the least neighbours are written, so that a node with very many edges can be split in the joins
        low = written(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(pairs.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = written(small.where("a <> b").distinct())
        discard(now, low, large, least)
        now, before, seen = after, seen, summary(after)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
