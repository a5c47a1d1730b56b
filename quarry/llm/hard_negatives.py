"""Operator 13: hard negatives by a norm-bucketed search.

Rows are sorted by norm, longest first, and cut into buckets, each a matrix of whole numbers with its largest norm.
Anchors are taken block by block; a block is small (BLOCK_VALUES numbers), so it goes to all tasks, and each task
multiplies it with its buckets. By Cauchy-Schwarz no row of a bucket scores more than its norm times the anchor's, so an
anchor passes a bucket over when that is below what it still looks for: the lower end of its window, or its k-th score
so far. Buckets that all of a block's anchors pass over are not read. A first job over the longest rows finds k-th
scores, which the second, over the others, begins with; both are merged. First each anchor's positives are searched so,
then, with their windows, the negatives.

Scores are exact: products of whole numbers, in float32 or float64 where the norms show that every sum fits, else in
Python's integers; scores beyond a long are given as its nearest end. Rows without a label or vector, or with a null or
non-finite component, take no part. Vectors of unequal lengths are filled up with zeros. Null vec_id: a row like any
other, last among equal scores, never an anchor. Repeated rows: rows of their own, so an anchor's copy may be its
positive. A positive with a negative score has an empty window. Empty table: no rows. Columns other than those named
are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ROW, forget, numbered, ranked, shared_dir, written

#: Numbers of a block of anchors, of a bucket, and of a matrix of scores.
BLOCK_VALUES, BUCKET_VALUES, SCORES = 1 << 20, 1 << 16, 1 << 18
#: Of the buckets, one in HEAD is searched first.
HEAD = 16
LONG = (1 << 63) - 1
BUCKET = "range int, norm double, ids binary, uids binary, labels binary, vectors binary"
HITS = "anchor int, slot int, score long, id long, known boolean"
HITS_ARROW = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("known", pa.bool_())])


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label, q (whole numbers) of the rows that take part; ``rows``: vec_id, label, and the vector."""
    whole = F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")).cast("double"))
    fit = F.col("label").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fit).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("q"))


def _packed(values: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def buckets(rows: DataFrame, width: int) -> DataFrame:
    """BUCKET: rows (id, uid, label, q, norm) in order of norm, as many together as take BUCKET_VALUES numbers."""
    size = max(1, BUCKET_VALUES // max(1, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                ids, uids, labels, norms = (part.column(i) for i in range(4))
                known = np.array([i is not None for i in ids.to_pylist()])
                numbers = np.stack([ids.fill_null(LONG).to_numpy(zero_copy_only=False), known.astype(np.int64)])
                vectors = _packed(part.column(4).to_pylist(), width)
                if max(norms.to_pylist()) < 1 << 24:
                    vectors = vectors.astype(np.float32)
                row = (at, max(norms.to_pylist()), numbers.tobytes(), uids.to_numpy().tobytes(), labels.to_numpy().tobytes(), vectors.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.float64(), *[pa.binary()] * 4), strict=True)], ["range", "norm", "ids", "uids", "labels", "vectors"])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (256 * size)))
    order = [F.desc("norm"), F.col("uid")]
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(sorted_.select("id", "uid", "label", "norm", "q").mapInArrow(pack, BUCKET), "buckets")


class Found:
    """The best k of each slot of each anchor so far, by score and smaller id, of all that a task has met."""

    def __init__(self, shape: tuple[int, int], k: int, score: np.ndarray, last: np.ndarray):
        self.shape, self.k, self.score, self.last = shape, k, score.copy(), last.copy()
        self.kept: list[np.ndarray] = []
        self.new, self.held = [], 0

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.new.append((anchor, slot, score, ids, known))
        self.held += len(anchor)
        if self.held > max(1 << 17, 2 * (len(self.kept[0]) if self.kept else 0)):
            self.close()

    def close(self) -> None:
        """Cuts to the best k; the k-th of a full slot is what later ones must beat."""
        if not self.new:
            return
        parts = [self.kept, *self.new] if self.kept else self.new
        anchor, slot, score, ids, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        group = anchor.astype(np.int64) * self.shape[1] + slot
        order = np.lexsort((~known, ids, -score, group))
        group = group[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(group)]])))
        keep = order[place < self.k]
        self.kept = [c[keep] for c in (anchor, slot, score, ids, known)]
        full = order[place == self.k - 1]
        a, s, better = anchor[full], slot[full], score[full]
        wins = (better > self.score[a, s]) | (better == self.score[a, s]) & (ids[full] < self.last[a, s])
        self.score[a[wins], s[wins]], self.last[a[wins], s[wins]] = better[wins], ids[full][wins]
        self.new, self.held = [], 0


class Block:
    """A block of anchors, and for each slot of each what is looked for: low to high, at least as good as (score, last)."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, k: int, low: np.ndarray, high: np.ndarray):
        self.uids, self.ids, self.labels, self.vectors, self.same, self.k, self.low, self.high = uids, ids, labels, vectors, same, k, low, high
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.score, self.last = np.full(low.shape, -LONG - 1, np.int64), np.full(low.shape, LONG, np.int64)

    def least_norm(self) -> float:
        """Rows with smaller norms are passed over by every anchor; a little less than the bound itself."""
        least = np.maximum(self.low, self.score).astype(float)
        least = np.where(self.low > self.high, np.inf, least).min(axis=1)
        with np.errstate(divide="ignore"):
            return float(np.where(least <= 0, 0, np.maximum(least, 0) / np.maximum(self.norms, 1e-9)).min() * (1 - 1e-9))

    def bounded(self, kth: list) -> None:
        """The k-th of each slot that a first search has filled."""
        for r in kth:
            self.score[r["anchor"], r["slot"]], self.last[r["anchor"], r["slot"]] = r["score"], r["id"]

    def scores(self, some: slice, vectors: np.ndarray, norm: float) -> np.ndarray:
        most = float(self.norms[some].max()) * norm
        if most < 1 << 24:
            return (self.vectors[some].astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
        if most < 1 << 53:
            return (self.vectors[some] @ vectors.T).astype(np.int64)
        rows = [[int(x) for x in v] for v in vectors]
        return np.array([[max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(a, v, strict=True)))) for v in rows] for a in self.vectors[some]], np.int64)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(self.low.shape, self.k, self.score, self.last)
        for b in batches:
            for _, norm, ids, uids, labels, vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                uids, labels, (ids, known) = np.frombuffer(uids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(ids, np.int64).reshape(2, -1)
                width = self.vectors.shape[1]
                vectors = np.frombuffer(vectors, np.float32 if len(vectors) == 4 * len(uids) * width else np.float64).reshape(-1, width)
                at = max(1, SCORES // len(uids))
                for first in range(0, len(self.uids), at):
                    self._bucket(found, first, slice(first, first + at), norm, ids, known.astype(bool), uids, labels, vectors)
        found.close()
        if found.kept:
            anchor, slot, score, ids, known = found.kept
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(slot, pa.int32()), pa.array(score), pa.array(ids), pa.array(known)], schema=HITS_ARROW)

    def _bucket(self, found: Found, first: int, some: slice, norm: float, ids: np.ndarray, known: np.ndarray, uids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        low = np.maximum(self.low[some], found.score[some])
        low = np.where(self.low[some] > self.high[some], LONG, low).min(axis=1)
        reach = self.norms[some] * norm * (1 + 1e-9) >= low.astype(float)
        if not reach.any():
            return
        scores = self.scores(some, vectors, norm)
        label = self.labels[some, None] == labels
        row, column = np.nonzero((scores >= low[:, None]) & (label if self.same else ~label) & reach[:, None])
        if self.same:
            own = (self.uids[some][row] == uids[column]) & (self.ids[some][row] == ids[column])
            row, column = row[~own], column[~own]
        score, row, ids, known = scores[row, column], row + first, ids[column], known[column]
        for s in range(self.low.shape[1]):
            fits = (score >= self.low[row, s]) & (score <= self.high[row, s])
            best, last = found.score[row, s], found.last[row, s]
            fits &= (score > best) | (score == best) & (ids <= last)
            if fits.any():
                found.add(row[fits], np.full(int(fits.sum()), s, np.int32), score[fits], ids[fits], known[fits])


def _searched(table: DataFrame, block: Block, head: int) -> DataFrame:
    """HITS of ``block``, cut to the best k of each slot: first in the ranges up to ``head``, then with their k-th scores
    in the others."""
    best = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.desc("known"), "id")

    def job(part: DataFrame) -> DataFrame:
        hits = part.where(F.col("norm") >= block.least_norm()).mapInArrow(block.search, HITS)
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= block.k)

    first = written(job(table.where(F.col("range") < head)), "hits")
    # One row for each slot of each anchor at most.
    block.bounded(first.where(F.col("rank") == block.k).collect())
    both = first.drop("rank").unionByName(job(table.where(F.col("range") >= head)).drop("rank"))
    out = written(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= block.k), "hits")
    forget(first)
    return out


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_values: int = BLOCK_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor among ``rows`` (id,
    label, q) and each of its best positives, the best negatives that score ``low`` to ``high`` percent of it."""
    spark = rows.sparkSession
    vectors = written(rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    held = numbered(vectors).withColumn("uid", F.xxhash64(*ROW))
    width = held.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    table = buckets(held, max(1, width))
    head = -(-((table.agg(F.coalesce(F.max("range"), F.lit(0))).first()[0]) + 1) // HEAD)
    each = max(1, block_values // max(1, width))
    anchors = held.where(is_anchor)
    # Anchors of like norms share a block, so that they pass over the same buckets.
    anchors = written(ranked(anchors.withColumn("_all", F.lit(0)), ["_all"], ["norm", "id", "uid"], "place").drop("_all", *ROW), "anchors")
    folder, made = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", []
    for n in range(math.ceil(anchors.count() / each)):
        # At most ``each`` rows.
        own = anchors.where(F.col("place").between(n * each, n * each + each - 1)).orderBy("place").collect()
        given = [np.array([r[c] for r in own], np.int64) for c in ("uid", "id", "label")]
        matrix = _packed([r["q"] for r in own], max(1, width))
        any_ = np.full((len(own), 1), -LONG - 1, np.int64)
        met = _searched(table, Block(*given, matrix, True, positives, any_, -(any_ + 1)), head)
        found = met.collect()
        lows, highs = np.full((len(own), positives), 1, np.int64), np.zeros((len(own), positives), np.int64)
        for r in found:
            lows[r["anchor"], r["rank"] - 1], highs[r["anchor"], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
        hits = _searched(table, Block(*given, matrix, False, negatives, lows, highs), head)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(own)], "anchor int, anchor_id long")
        number = lambda c, known: F.when(F.col(known), F.col(c))
        pairs = met.select("anchor", (F.col("rank") - 1).alias("slot"), number("id", "known").alias("positive_id"), F.col("score").alias("positive_score"))
        rows_of = hits.select("anchor", "slot", "rank", number("id", "known").alias("negative_id"), F.col("score").alias("negative_score"))
        out = rows_of.join(pairs, ["anchor", "slot"]).join(names, "anchor")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("overwrite").parquet(f"{folder}/{n}")
        made.append(f"{folder}/{n}")
        forget(met)
        forget(hits)
    for t in (vectors, table, anchors):
        forget(t)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(*made) if made else spark.createDataFrame([], schema)
