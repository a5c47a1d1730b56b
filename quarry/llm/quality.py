"""Operator 4: quality by co-training of a content view and a metadata view.

Content: counts of byte trigrams of the text. Metadata: language, source, length, lines, line length and repetition, in
buckets. Each view is a naive Bayes model over counts, calibrated by logistic regression. It starts from a bounded
sample of labelled documents; then, in each round, every document of the table of which one view is confident
gives its counts to the other view. At last a logistic regression combines both views' scores for all documents.
Naive Bayes needs counts only, so a round is one pass whose sums have a fixed size.

Null text, lang, source or n_chars: an empty text or value of its own. Very long texts: counted whole, one at a time.
An empty table gives no rows. A doc_id with both labels counts as either; of documents that share a labelled doc_id one
is learnt from. Without labels of both kinds every document
is kept with score 1. Repeated rows are scored each. Other columns pass through ``keep`` untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, small_batches, written

TEXT, META = 1 << 15, 576
#: Labelled documents used at most: three quarters to fit, the rest to calibrate.
LABELLED = 4000


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's byte trigrams, and counts."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64), np.empty(0)
    h = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)
    counts = np.bincount(h >> np.uint32(17), minlength=TEXT)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


def metadata(text: str | None, lang: str | None, source: str | None, n_chars: int | None, distinct: int = 0) -> np.ndarray:
    """Buckets of what is known about the document; distinct: how many trigrams it has, a measure of repetition."""
    text = text or ""
    n = len(text) if n_chars is None else max(int(n_chars), 0)
    lines = text.count("\n") + 1
    def bits(x):
        return min(int(2 * np.log2(x + 1)), 63)

    return np.array([zlib.crc32(b"\0" if lang is None else lang.encode("utf-8", "surrogatepass")) % 64, 64 + zlib.crc32(b"\0" if source is None else source.encode("utf-8", "surrogatepass")) % 256, 320 + bits(n), 384 + bits(lines), 448 + bits(n // lines), 512 + min(int(4 * distinct / (3 * np.sqrt(n) + 1)), 63)])


def views(text: str | None, *known) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    c = content(text)
    return c, metadata(text, *known, len(c[0]))


class View:
    """Naive Bayes over counts of two classes: the mean log odds of a document's counts."""

    def __init__(self, counts: np.ndarray, smooth: float = 1.0):
        p = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
        self.odds = np.log(p[1]) - np.log(p[0])

    def score(self, at: np.ndarray, n: np.ndarray | float = 1.0) -> float:
        if not len(at):
            return 0.0
        w = np.broadcast_to(n, at.shape)
        return float((self.odds[at] * w).sum() / w.sum())


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method; elementwise, the columns are two or three."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
        g = (x * (p - y)[:, None]).sum(axis=0) + ridge * w
        h = (x[:, :, None] * x[:, None, :] * (p * (1 - p) + 1e-9)[:, None, None]).sum(axis=0) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(w: np.ndarray, *z: float) -> float:
    return 1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(w, z, strict=False)) + w[-1], -30, 30)))


class CoTrained:
    """Both views over counts by class. Their scores are calibrated apart and together by what ``calibrate`` is given."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.text, self.meta = View(text), View(meta)
        self.by_text = self.by_meta = self.both = None

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """z: scores of held documents by both views; y: their labels."""
        self.by_text, self.by_meta, self.both = logistic(z[:, :1], y), logistic(z[:, 1:], y), logistic(z, y)

    def scores(self, c: tuple, m: np.ndarray) -> tuple[float, float]:
        return self.text.score(*c), self.meta.score(m) * len(m)

    def score(self, *document) -> float:
        return chance(self.both, *self.scores(*views(*document)))


def _columns(docs: DataFrame) -> list:
    return ["text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")]


def _documents(b: pa.RecordBatch, first: int = 0) -> Iterator[tuple]:
    return zip((t.as_py() for t in b.column(first)), *(b.column(first + k).to_pylist() for k in (1, 2, 3)), strict=True)


#: What tasks send of the counts that they have summed.
SUMS = "view int, quality int, at int, n double"


def _sent(text: np.ndarray, meta: np.ndarray) -> Iterator[pa.RecordBatch]:
    for view, counts in enumerate((text, meta)):
        q, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), view), pa.int32()), pa.array(q, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[q, at])], ["view", "quality", "at", "n"])


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both views by class, from SUMS rows: at most 2 * (TEXT + META) rows reach the driver."""
    got = parts.groupBy("view", "quality", "at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, TEXT)), np.zeros((2, META))
    for view in (0, 1):
        x = got[got["view"] == view]
        out[view][x["quality"].to_numpy(int), x["at"].to_numpy(int)] = x["n"].to_numpy()
    return out


def _add(text: np.ndarray, c: tuple) -> None:
    """A document's content, long or short, counts as a thousand trigrams."""
    if len(c[0]):
        text[c[0]] += c[1] / c[1].sum() * 1000


def labelled_rows(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """text, lang, source, n_chars, quality, fold of ``labelled`` labelled documents at most: one row for each label, the
    least of those that share its doc_id."""
    sample = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(labelled)
    found = docs.select("doc_id", *_columns(docs)).join(F.broadcast(sample), "doc_id")
    one = found.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    return one.select("d.*", "quality", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)).alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = 2, sure: float = 0.97) -> CoTrained | None:
    """None where the labels have not both kinds. ``labelled`` bounds the sample; pseudo-labels come from all of ``docs``.
    Counts are summed by the tasks, and of the held documents (a quarter of the sample) only scores reach the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(labelled_rows(docs, labels, labelled), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta = np.zeros((2, TEXT)), np.zeros((2, META))
        for b in batches:
            for q, d in zip(b.column(4).to_pylist(), _documents(b), strict=True):
                c, m = views(*d)
                _add(text[q], c)
                meta[q, m] += 1
        yield from _sent(text, meta)

    text, meta = _summed(rows.where("fold != 0").mapInArrow(counted, SUMS))

    def calibrated(model: CoTrained) -> CoTrained | None:
        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = [model.scores(*views(*d)) for d in _documents(b)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in z], pa.float64()), pa.array([x for _, x in z], pa.float64()), b.column(4)], ["text", "meta", "quality"])

        z = rows.where("fold = 0").mapInArrow(scored, "text double, meta double, quality int").orderBy("text", "meta", "quality").toPandas()
        if z["quality"].nunique() < 2:
            return None
        model.calibrate(z[["text", "meta"]].to_numpy(), z["quality"].to_numpy(float))
        return model

    if not text.any() or not (meta[0].any() and meta[1].any()):
        return None
    model = calibrated(CoTrained(text, meta))
    for _ in range(rounds if model else 0):
        shared = spark.sparkContext.broadcast(model)

        def exchanged(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, more_text, more_meta = shared.value, np.zeros((2, TEXT)), np.zeros((2, META))
            for b in batches:
                for d in _documents(b):
                    c, a = views(*d)
                    z = m.scores(c, a)
                    by_text, by_meta = chance(m.by_text, z[0]), chance(m.by_meta, z[1])
                    if by_text > sure or by_text < 1 - sure:
                        more_meta[int(by_text > 0.5), a] += 1
                    if by_meta > sure or by_meta < 1 - sure:
                        _add(more_text[int(by_meta > 0.5)], c)
            yield from _sent(more_text, more_meta)

        more = [text.copy(), meta.copy()]
        for counts, new in zip(more, _summed(docs.select(*_columns(docs)).mapInArrow(exchanged, SUMS)), strict=True):
            # Pseudo-labels of a class count as much as its labelled documents, however many they are.
            for q in (0, 1):
                if new[q].sum():
                    counts[q] += new[q] * (counts[q].sum() / new[q].sum())
        model = calibrated(CoTrained(*more))
        shared.unpersist()
    forget(rows)
    return model


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, quality (the combined probability), kept; one row per row of ``docs``."""
    model = fit(docs, labels, **how)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1.0).alias("quality"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(*d) for d in _documents(b, 1)], pa.float64())], ["doc_id", "quality"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs)).mapInArrow(batches, "doc_id long, quality double")
    return scored.withColumn("kept", F.col("quality") >= threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; no shuffle."""
    model = fit(docs, labels, **how)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in rows:
            columns = (b.column(k) for k in where)
            documents = zip((t.as_py() for t in next(columns)), *(c.to_pylist() for c in columns), strict=True)
            yield b.filter(pa.array([m.score(*d) >= threshold for d in documents], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
