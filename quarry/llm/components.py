"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b. Returns node, root for every node with a link; root is the smallest node that it reaches."""
    def low(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    edges, was = written(low(links), "stars"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = low(large)
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").where("b != m").select("b", F.col("m").alias("c")).toDF("a", "b").unionByName(parent.toDF("a", "b"))
        new = written(low(small), "stars")
        now = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        forget(edges)
        edges = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components: edges still change after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
