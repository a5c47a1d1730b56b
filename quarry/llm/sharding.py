"""Operator 2: shards of near-equal bytes by sampled splitters.

Records are keyed by a hash of their text, so equal texts lie in one range. A size-weighted key sample gives
quantile boundaries of many small ranges; overfull ranges are subdivided by exact counts; whole ranges are then
dealt to shards, largest first. Only a single text whose copies exceed a whole shard's share is split.

Null text: a text of no bytes. Empty table: no rows. Repeated rows: each is a record of its own. Null doc_id:
kept, ranked like any other value. Very long texts: a size and two hashes like any other. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ranked, written

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _boundaries(sample: pd.DataFrame, ranges: int) -> np.ndarray:
    """Keys at which a new range starts: weighted quantiles, and hot keys on their own."""
    by_key = sample.groupby("key", sort=True)["weight"].sum()
    keys, ends = by_key.index.to_numpy(), by_key.cumsum().to_numpy()
    step = ends[-1] / ranges
    starts = keys[np.unique(np.searchsorted(ends, step * np.arange(1, ranges)))]
    hot = keys[by_key.to_numpy() > step]
    after = hot[hot < np.iinfo("int64").max] + 1
    return np.unique(np.concatenate([starts, hot, after]).astype("int64"))


def _deal(sizes: list[tuple[tuple[int, int], int]], shards: int) -> list[tuple[int, int, int]]:
    """(range, part, shard): largest first, each to the emptiest shard."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for (r, part), size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out.append((r, part, s))
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 64, sample_rows: int = 50_000, rounds: int = 4) -> DataFrame:
    """``sample_rows`` is the expected sample size, ``shards * ranges_per_shard`` the number of ranges: both bound what the driver holds."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.xxhash64("doc_id", text).alias("spread")), "shard-keys")
    rows, total = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    # Poisson sampling with probability in proportion to size; a record's weight is the bytes that it stands for.
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(sample_rows / total))
    coin = F.pmod(F.xxhash64("spread", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = slim.where(coin < chance).select("key", (F.col("size") / chance).alias("weight")).toPandas()
    starts = _boundaries(sample, shards * ranges_per_shard) if len(sample) else np.array([], "int64")

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, key.to_numpy(), side="right").astype("int32"))

    placed = written(slim.select("*", range_of("key").alias("range")), "shard-ranges")
    # Overfull ranges are halved and halved again by a hash of the text; a range of one text only beyond a shard's share.
    share, fine = total / shards, total / shards / 8
    parts: dict[int, tuple[int, bool]] = {}
    for _ in range(rounds):
        placed_parts = _parts(placed, parts)
        found = placed_parts.groupBy("range", "part").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        full = {}
        for f in found:
            alone = f.low == f.high
            if f["size"] > (share if alone else fine):
                n = int(np.ceil(f["size"] / fine))
                was, by_row = parts.get(f["range"], (1, False))
                full[f["range"]] = (max(was * 2 if was > 1 else n, n), by_row or alone)
        if not full:
            break
        parts |= full
    else:
        found = _parts(placed, parts).groupBy("range", "part").agg(F.sum("size").alias("size")).collect()
    deal = spark.createDataFrame(_deal([((f["range"], f["part"]), f["size"]) for f in found], shards), "range int, part int, shard int")
    sharded = _parts(placed, parts).join(F.broadcast(deal), ["range", "part"]).select("doc_id", "size", "text_crc32", "shard", "spread")
    out = ranked(sharded, ["shard"], ["doc_id", "spread"], "slot", rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _parts(placed: DataFrame, parts: dict[int, tuple[int, bool]]) -> DataFrame:
    if not parts:
        return placed.withColumn("part", F.lit(0))
    spark = placed.sparkSession
    known = spark.createDataFrame([(r, n, by_row) for r, (n, by_row) in parts.items()], "range int, parts int, by_row boolean")
    dealt = F.pmod(F.xxhash64(F.when(F.col("by_row"), F.col("spread")).otherwise(F.col("key")), F.lit(5)), F.col("parts")).cast("int")
    return placed.join(F.broadcast(known), "range", "left").withColumn("part", F.coalesce(dealt, F.lit(0))).drop("parts", "by_row")
