"""A crawl as breadth-first expansion: each level joins the frontier with its links and drops what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators import ranks

MAX_DEPTH = 8


def expand(seeds: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """seeds: id; edges: src, dst. Returns id, depth: the first level at which each id is reached."""
    seen = frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        found = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
        if d % 3 == 0:  # written, or each level would plan all levels before it twice
            seen = ranks.written(seen, "seen")
            frontier = seen.where(F.col("depth") == d)
    return seen


def slots(pages: DataFrame, interval_ms) -> DataFrame:
    """The start of each fetch so that a host is met once in an interval: its place among the host's pages by id."""
    return ranks.placed(pages, "host", ["page_id"], "turn").withColumn("start_ms", ((F.col("turn") - 1) * interval_ms).cast("long")).drop("turn")


def slots_of_batch(pages: DataFrame, free: DataFrame, interval_ms, now_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """pages: host, page_id of one batch that arrives at ``now_ms``; free: host, free_ms, from when each host may be met
    again, as earlier batches left it. The batch's slots (host, page_id, start_ms), and the table for the next batch:
    both written, so a batch that is run again takes the same slots. A host's time that has passed binds nobody."""
    placed = ranks.placed(pages, "host", ["page_id"], "turn").where(F.col("host").isNotNull())
    begin = F.greatest(F.coalesce("free_ms", F.lit(0)), F.lit(now_ms))
    start = (begin + (F.col("turn") - 1) * interval_ms).cast("long")
    slots = ranks.written(placed.join(free, "host", "left").select("host", "page_id", start.alias("start_ms")), "slots")
    met = slots.groupBy("host").agg((F.max("start_ms") + interval_ms).cast("long").alias("met_ms"))
    after = free.where(F.col("free_ms") > now_ms).join(met, "host", "full").select("host", F.coalesce("met_ms", "free_ms").alias("free_ms"))
    return slots, ranks.written(after, "free")
