"""Which values occur in which pages: whole, by anchors of a rolling hash, and sentence by sentence, by postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.functions import text
from quarry.operators.ranks import written

#: Bytes of an anchor; a shorter value is its own anchor.
ANCHOR = 16
#: Bits of the filter that says which windows of a page may be an anchor, and bytes of a page that are hashed at once.
FILTER, RUN = 1 << 20, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` bytes, the same on every machine; of no bytes, one."""
    if len(raw) < size or not size:
        return np.zeros(0 if size else 1, np.int64)
    out = np.full(len(raw) - size + 1, np.uint64(size))
    for j in range(size):
        out = out * _STEP + raw[j : len(raw) - size + 1 + j]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(27))).view(np.int64)


def _raw(value: str) -> np.ndarray:
    return np.frombuffer(value.encode(), np.uint8)


def anchors(items: DataFrame) -> DataFrame:
    """items: item_id, q. item_id, size, anchor: of each value the window with the smallest hash, so that values with a
    common beginning have different ones."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            raws = [_raw(q) for q in b.column(1).to_pylist()]
            sizes = [min(ANCHOR, len(r)) for r in raws]
            found = [int(window_hashes(r, n).min()) for r, n in zip(raws, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(found, pa.int64())], ["item_id", "size", "anchor"])

    kind = dict(items.dtypes)["item_id"]
    return items.where(F.col("q").isNotNull()).select("item_id", "q").mapInArrow(batches, f"item_id {kind}, size int, anchor long")


def met_anchors(documents: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """documents: doc_id, p. doc_id, anchor for each window that the filter lets pass, once: one pass over each text,
    run by run, whatever its length."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, out = [], []
            for i, p in enumerate(b.column(1).to_pylist()):
                raw, found = _raw(p), []
                for start in range(0, max(1, len(raw)), RUN):
                    for n in sizes:
                        h = window_hashes(raw[start : start + RUN + max(n - 1, 0)], n)
                        found.append(np.unique(h[bits[h & (FILTER - 1)]]))
                found = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                at.append(np.full(len(found), i))
                out.append(found)
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(out), pa.int64())], ["doc_id", "anchor"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.where(F.col("p").isNotNull()).select("doc_id", "p").mapInArrow(batches, f"doc_id {kind}, anchor long")


def included_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents: doc_id, text; items: item_id, text. doc_id, item_id for each item that its document holds, both
    preprocessed; a blank item is in every document. doc_id and item_id are keys.

    Pages and items meet by an equal anchor, and then both whole texts are compared, so hashes decide nothing. The
    filter has a fixed size: with many more items than bits it lets most windows pass, and only the join grows."""
    pre = text.preprocess(F.col("text"))
    own = written(anchors(items.select("item_id", pre.alias("q"))), "anchors")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())
    if not sizes:
        return documents.crossJoin(items.limit(0)).select("doc_id", "item_id")
    bit = F.pmod("anchor", F.lit(FILTER))
    words = own.groupBy((bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(anchor, {FILTER}) % 64 as int))")).alias("bits"))
    # FILTER / 64 rows at most.
    filled = np.zeros(FILTER // 64, np.int64)
    for r in words.collect():
        filled[r["w"]] = r["bits"]
    bits = np.unpackbits(filled.view(np.uint8), bitorder="little").astype(bool)
    met = met_anchors(documents.select("doc_id", pre.alias("p")), sizes, bits)
    pairs = met.join(own.select("anchor", "item_id"), "anchor").select("doc_id", "item_id")
    both = pairs.join(items.select("item_id", F.col("text").alias("_value")), "item_id").join(documents.select("doc_id", "text"), "doc_id")
    return both.where(F.contains(pre, text.preprocess(F.col("_value")))).select("doc_id", "item_id")


def holding_sentences(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id for each item all of whose sentences are sentences of the document, letter by letter; an item
    without sentences is in every document. doc_id and item_id are keys.

    A set-containment join over postings (sentence hash, doc_id), of which only those of items' sentences are kept: an
    item meets documents by the rarest of its sentences, its other sentences are looked up for the documents that hold
    that one, and last the texts themselves are compared."""
    none = F.lit(0).cast("long")

    def hashes(c):
        each = F.array_distinct(F.transform(text.sentences(c), lambda s: F.xxhash64(s)))
        return F.when(F.size(each) == 0, F.array(none)).otherwise(each)

    needs = written(items.where(F.col("text").isNotNull()).select("item_id", F.explode(hashes(F.col("text"))).alias("s")), "sentences")
    wanted = needs.select("s").distinct()
    # Every document holds the sentence of an item without any.
    held = F.explode(F.array_union(hashes(F.col("text")), F.array(none))).alias("s")
    postings = written(documents.where(F.col("text").isNotNull()).select("doc_id", held).join(wanted, "s", "left_semi"), "postings")
    often = postings.groupBy("s").agg(F.count(F.lit(1)).alias("docs"))
    ranked = needs.join(often, "s", "left")
    rarest = ranked.groupBy("item_id").agg(F.min_by("s", F.struct("docs", "s")).alias("s"), F.count(F.lit(1)).alias("n"), F.count("docs").alias("known")).where("n = known")
    first = postings.join(rarest, "s").select("doc_id", "item_id", "n", F.col("s").alias("_first"))
    others = first.where("n > 1").join(needs, "item_id").where("s != _first").join(postings, ["doc_id", "s"], "left_semi")
    full = others.groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("found")).where("found = n - 1").select("doc_id", "item_id")
    pairs = first.where("n = 1").select("doc_id", "item_id").unionByName(full)
    both = pairs.join(items.select("item_id", F.col("text").alias("_value")), "item_id").join(documents.select("doc_id", "text"), "doc_id")
    return both.where(text.sentences_held(F.col("text"), F.col("_value"))).select("doc_id", "item_id")


def inclusion(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, full, sentences for the pairs that have either flag."""
    full = included_items(documents, items).withColumn("full", F.lit(True))
    phrases = holding_sentences(documents, items).withColumn("sentences", F.lit(True))
    either = full.join(phrases, ["doc_id", "item_id"], "full")
    return either.select("doc_id", "item_id", F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("sentences", F.lit(False)).alias("sentences"))
