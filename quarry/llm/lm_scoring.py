"""Operator 10: a hashed maximum-entropy language model with a class-factored softmax.

p(word | history) = p(class | history) p(word | class). Classes are bins of near-equal mass of the frequent words,
one of the end of a text, and one of all other words, seen or not; within a class a word has its smoothed share
of the counts. The class factor is a softmax over hashed history features (the word before, the two before, and
skips to the second and third before). It is trained by distributed gradient updates: in each round every
partition takes AdaGrad steps over its own documents from the shared weights, and Spark averages the results by
blocks of the table. Scoring gathers weight rows in numpy batches. Texts are read twice, for the counts and for the
numbers of their words, which are written; training and scoring read the numbers. Counts cover all training documents;
words beyond the broadcast dictionary (``frequent`` words at most) get their counts by a join.

Training documents: crc32(doc_id as text) mod 10 is not 0 (a null doc_id counts as an empty text). Null text: only
the end. Repeated rows: counted and scored each. Empty table: no rows. No training documents: score = base_score. Very
long texts: scored whole, in arrays that grow with that text. Columns other than doc_id and text are ignored. Weights are
averaged over tasks, so ``score`` depends on how rows are dealt to tasks; ``base_score`` does not.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import most_frequent, written

CLASSES, ROWS, FAMILIES = 16, 1 << 16, 4
REST, END = 0, 1
SMOOTH = 0.1
#: Rows of the weight table in one block of the average.
BLOCK = 1 << 10
#: Groups in which tasks' weights are averaged before the last average.
SALTS = 64
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(docs: DataFrame, kept: int = 300_000) -> DataFrame:
    """word (binary), n: of all texts; a task sums before the shuffle, ``kept`` words at a time."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return b

        for b in rows:
            for t in b.column(0):
                counts.update(tokens_of(t.as_py()))
                if len(counts) > kept:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent words' numbers, counts and classes; what every task needs besides the weights. Bounded by ``frequent``."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, ends: int):
        self.words, self.total, self.distinct = words, total, distinct
        self.mass = total + SMOOTH * (distinct + 1)
        share = np.concatenate([[0.0, ends + SMOOTH if ends else 0.0], counts + SMOOTH])
        self.counts = np.concatenate([[0, ends], counts]).astype(np.int64)
        # Numbers: 0 any other word, 1 the end, then the words.
        upto = np.cumsum(share[2:])
        bins = (upto - share[2:] / 2) / (upto[-1] if len(upto) else 1) * (CLASSES - 2)
        self.classes = np.concatenate([[REST, END], 2 + np.minimum(bins.astype(int), CLASSES - 3)]).astype(np.int8)
        by_class = np.bincount(self.classes, weights=share, minlength=CLASSES)
        by_class[REST] = self.mass - by_class[1:].sum()
        self.prior = np.log(np.maximum(by_class / self.mass, 1e-12)).astype(np.float32)
        self.base = np.log10((self.counts + SMOOTH) / self.mass)
        self._numbers: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_numbers": None}

    def numbers(self) -> dict[bytes, int]:
        if self._numbers is None:
            self._numbers = {w: i + 2 for i, w in enumerate(self.words)}
        return self._numbers


_unpacked: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The worker's one copy of a broadcast vocabulary."""
    if id(shared.value) not in _unpacked:
        _unpacked.clear()
        _unpacked[id(shared.value)] = shared.value
    return _unpacked[id(shared.value)]


def features(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the rows of the weight table: before, two before, skip to the second and to the third before.
    first: where the token's document begins; histories don't cross it."""
    n = len(ids)
    at = np.arange(n)
    before = []
    for k in (1, 2, 3):
        inside = at - k >= first
        before.append(np.where(inside, ids[np.maximum(at - k, 0)], -1).astype(np.int64).view(np.uint64) + np.uint64(2))
    one, two, three = before
    keys = np.stack([one * _SALT[0], (one * _SALT[1] + two) * _SALT[0], two * _SALT[2], three * _SALT[3]])
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys >> np.uint64(48)).astype(np.int64) & (ROWS - 1)


def logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each token's classes, the largest at 0."""
    z = weights.take(rows.ravel(), axis=0).reshape(*rows.shape, -1).sum(axis=0)
    z += prior
    z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]  # along the longer axis: a call for each class, not each token
    return z


def log_classes(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """ln p(class | history) for each token."""
    z = logits(weights, prior, rows)
    return z - np.log(np.einsum("ij->i", np.exp(z)))[:, None]


def runs(parts: Iterator, size: int) -> Iterator[list]:
    """Documents (sized, one element a token) in lists of about ``size`` tokens."""
    run, held = [], 0
    for p in parts:
        run.append(p)
        held += len(p)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def joined(run: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, first: of a run's arrays of numbers; and where each array begins."""
    lengths = [len(p) for p in run]
    starts = np.cumsum([0, *lengths[:-1]])
    return np.concatenate(run), np.repeat(starts, lengths), starts


def numbers(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), np.int32) for x in column)


def encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, held_out; n_tokens, n_known and base (sum of scores) of the numbered words; ids: the words' numbers, 32
    bits each, and the end's; the other words (rest) and how often the text has each (times)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocabulary)
        get, base, counted = v.numbers().get, np.where(np.arange(len(v.base)) > 0, v.base, 0.0), (v.counts > 0).astype(np.int64)
        for b in rows:
            at = 0
            for words in runs(([*tokens_of(t.as_py()), None] for t in b.column(1)), 1 << 16):
                parts = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in words]
                for p in parts:
                    p[-1] = 1
                ids, first, starts = joined(parts)
                rare: dict[int, dict[bytes, int]] = {}
                others = np.flatnonzero(ids == 0)
                for k, i in zip((np.searchsorted(starts, others, side="right") - 1).tolist(), (others - first[others]).tolist(), strict=True):
                    mine, w = rare.get(k), words[k][i]
                    if mine is None:
                        mine = rare[k] = {}
                    mine[w] = mine.get(w, 0) + 1
                found = [rare.get(k, {}) for k in range(len(words))]
                keys = b.slice(at, len(words))
                at += len(words)
                yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(2), pa.array([len(p) for p in parts], pa.int64()), pa.array(np.add.reduceat(counted[ids], starts)), pa.array(np.add.reduceat(base[ids], starts)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([list(f) for f in found], pa.list_(pa.binary())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "rest", "times"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(batches, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids binary, rest array<binary>, times array<long>")


def gradient_step(weights: np.ndarray, squares: np.ndarray, prior: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a minibatch, in place, on the rows that it touches."""
    n, g = len(target), logits(weights, prior, rows)
    np.exp(g, out=g)
    g /= np.einsum("ij->i", g)[:, None]
    g[np.arange(n), target] -= 1
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # 16 bits, as many as ROWS needs, are sorted by radix
    flat = flat[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    # Two classes are added at once, as the parts of a complex number: half the calls.
    row, g = flat[at], np.add.reduceat(g.take(order % n, axis=0).view(np.complex64), at, axis=0).view(np.float32)
    scale = squares.take(row, axis=0)
    scale += g * g
    squares[row] = scale
    np.sqrt(scale, out=scale)
    scale += 1e-4
    g *= rate
    g /= scale
    weights[row] = weights.take(row, axis=0) - g


def train(docs: DataFrame, vocabulary, rounds: int = 2, batch: int = 8192, rate: float = 0.15) -> np.ndarray:
    """Weights (ROWS by CLASSES) after ``rounds`` averages; each round takes its share of the ``encoded`` documents."""
    spark = docs.sparkSession
    weights = np.zeros((ROWS, CLASSES), np.float32)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def batches(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, mine = _vocabulary(vocabulary), shared.value.copy()
            squares, seen = np.zeros_like(mine), 0
            for run in runs((x for b in rows for x in numbers(b.column(0))), 1 << 16):
                ids, first, _ = joined(run)
                targets, feats = v.classes[ids], features(ids, first)
                for a in range(0, len(ids), batch):
                    gradient_step(mine, squares, v.prior, feats[:, a : a + batch], targets[a : a + batch], rate)
                seen += len(ids)
            if seen:
                n = ROWS // BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([mine[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in range(n)], pa.binary())], ["block", "tokens", "weights"])

        mine = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds)) == r).select("ids")
        parts = mine.mapInArrow(batches, "block int, tokens long, weights binary")
        # Every task sends each block once, so a block's rows grow with the input: they are averaged in SALTS groups first.
        some = parts.repartition("block", F.pmod(F.spark_partition_id(), F.lit(SALTS))).mapInArrow(averaged, parts.schema)
        # A fixed number of rows: the weight table once.
        for x in some.repartition("block").mapInArrow(averaged, parts.schema).collect():
            weights[x["block"] * BLOCK : (x["block"] + 1) * BLOCK] = np.frombuffer(x["weights"], np.float32).reshape(BLOCK, CLASSES)
        shared.unpersist()
    return weights


def averaged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, tokens, weights: for each block the mean by tokens, of rows that are read one at a time."""
    total: dict[int, np.ndarray] = {}
    seen: Counter = Counter()
    for b in rows:
        for k, n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            part = np.frombuffer(w.as_buffer(), np.float32).astype(float) * n
            total[k] = total[k] + part if k in total else part
            seen[k] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([seen[k] for k in total], pa.int64()), pa.array([(t / max(seen[k], 1)).astype(np.float32).tobytes() for k, t in total.items()], pa.binary())], ["block", "tokens", "weights"])


def score(docs: DataFrame, frequent: int = 1 << 18, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    training = docs.where(~F.col("held_out"))
    counts = written(word_counts(training), "word-counts")
    ends = training.count()
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = most_frequent(counts, "word", frequent).toPandas().sort_values(["n", "word"], ascending=[False, True])
    vocabulary = Vocabulary([bytes(w) for w in top["word"]], top["n"].to_numpy("int64"), total + ends, distinct + (ends > 0), ends)
    shared = spark.sparkContext.broadcast(vocabulary)
    texts = written(encoded(docs, shared).withColumn("row", F.monotonically_increasing_id()), "token-numbers")
    weights = spark.sparkContext.broadcast(train(texts.where(~F.col("held_out")), shared, rounds) if ends else None)
    all_frequent = distinct <= frequent

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = _vocabulary(shared), weights.value
        for b in rows:
            gains = [np.empty(0)]
            for run in runs(numbers(b.column(0)), 1 << 16):
                ids, first, starts = joined(run)
                gain = np.zeros(len(ids))
                if w is not None:
                    for a in range(0, len(ids), 8192):
                        c = v.classes[ids[a : a + 8192]]
                        gain[a : a + 8192] = (log_classes(w, v.prior, _slice(ids, first, a))[np.arange(len(c)), c] - v.prior[c]) / math.log(10)
                gains.append(np.add.reduceat(gain, starts))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(gains))], [*b.schema.names[1:], "gain"])

    sums = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]
    scored = written(texts.select("ids", *sums).mapInArrow(batches, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double"), "scored")
    part = texts.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    smooth = F.log10((F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)) / F.lit(vocabulary.mass))
    found = part.join(counts, "word", "left") if not all_frequent else part.withColumn("n", F.lit(None).cast("long"))
    rest = found.groupBy("row").agg(F.sum(F.col("times") * smooth).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return scored.join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(total + ends).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def _slice(ids: np.ndarray, first: np.ndarray, a: int) -> np.ndarray:
    """Features of the tokens from ``a`` on, with three tokens of history before them."""
    low = max(0, a - 3)
    return features(ids[low : a + 8192], first[low : a + 8192] - low)[:, a - low :]
