"""Operator 6: packing by cutting-stock column generation.

Documents are tokenised in Spark and cut into whole sequences and one tail each. The histogram of tail lengths (in
classes of ``step`` tokens, a fixed number) is a cutting-stock problem: a linear program over patterns, whose new
columns come from a knapsack dynamic program over the duals; rounded down, the rest first-fit decreasing. Tails,
ranked within their class in Spark, are then assigned to the patterns' places by a join.

Null text: one id (the end). Empty table: no rows. Repeated rows: packed as documents of their own. Very long texts: cut
into whole sequences and a tail, one text's ids held at a time. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ranked, small_batches, written

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
WORDS_KEPT = 400_000
#: The word pattern of the vocabulary, of lower-cased text; white space spelt out as Unicode has it.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+"


def _latin_pattern() -> str:
    """PATTERN for texts up to U+00FF, with their letters and numbers spelt out, for Python's own, faster matcher."""
    letters, numbers = ("".join(regex.findall(rf"\p{{{k}}}", "".join(map(chr, range(256))))) for k in "LN")
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r\x20\x85\xa0{letters}{numbers}]+"


class WordIds(dict):
    """Word of the tokenizer's pattern to its ids as little-endian bytes. The tokenizer drops white space and no merge
    crosses a word, so a text's ids are those of its words one after the other. New words are encoded many at a time:
    the last id of each is of a kind that ends words. Words up to U+00FF, being cut and lower-cased, need no more
    of the tokenizer than its bytes and merges: ``plain`` is the same without the rest."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.ascii_words = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.latin_words, self.beyond = re.compile(_latin_pattern()).findall, re.compile("[^\x00-\xff]").search

    def split(self, text: str) -> list[str] | None:
        """The text's words; None where the library alone is to say."""
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return self.ascii_words(text.lower())
        if not self.beyond(text):
            return self.latin_words(text.lower())
        if "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            return None
        return self.words(text.lower())

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self) + len(words) > WORDS_KEPT:
            self.clear()
        further = [w for w in words if self.beyond(w)]
        self.encode(self.plain, words if not further else [w for w in words if not self.beyond(w)])
        if further:
            self.encode(self.tokenizer, further)

    def encode(self, tokenizer, words: list[str]) -> None:
        runs = [words[i : i + 500] for i in range(0, len(words), 500)]
        for run, e in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(run):
                for w in run:
                    self[w] = self.whole(w)
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(run, (4 * cuts).tolist(), strict=True):
                self[w] = raw[a:b]
                a = b

    def look_up(self, texts: list[list[str] | None]) -> list[list[bytes] | None]:
        """The ids of each text's words. Every word is looked up once; only those not met before are looked at again."""
        found = [None if words is None else list(map(self.get, words)) for words in texts]
        missing = [[i for i, x in enumerate(f) if x is None] if f else [] for f in found]
        new = list({words[i] for words, at in zip(texts, missing, strict=True) for i in at})
        for a in range(0, len(new), WORDS_KEPT // 2):
            self.learn(new[a : a + WORDS_KEPT // 2])
            for words, f, at in zip(texts, found, missing, strict=True):
                for i in at:
                    if f[i] is None:
                        f[i] = self.get(words[i])
        return found


_tokenizers: dict[str, WordIds] = {}


def pieces_of(docs: DataFrame, vocabulary: str, width: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: pieces of ``width`` ids and one tail."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = WordIds(vocabulary)
        known = _tokenizers[vocabulary]
        end, step = np.asarray([end_id], "<u4").tobytes(), 4 * width
        for b in rows:
            out = ([], [], [], [], [])
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [t or "" for t in part.column(1).to_pylist()]
                texts = [known.split(t) for t in raw]
                looked_up = known.look_up(texts)
                for doc, text, found in zip(part.column(0).to_pylist(), raw, looked_up, strict=True):
                    ids = (known.whole(text) if found is None else b"".join(found)) + end
                    for s in range(0, len(ids), step):
                        piece = ids[s : s + step]
                        for column, v in zip(out, (doc, s // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        # The worker lives on for other stages: it gives the words' memory back.
        known.clear()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, PIECE)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack: a best pattern of items of ``sizes``, as counts, and its value. Items may come as often as they fit;
    those beyond what is asked for are cut off when patterns are rounded."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(s, c, side="right")
        if k:
            got = best[c - s[:k]] + v[:k]
            i = int(got.argmax())
            if got[i] > best[c - 1] + 1e-12:
                best[c], choice[c] = got[i], order[i]
                continue
        best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), counts


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, in elementwise operations: a few hundred rows need no threads."""
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for i in range(m):
        k = i + int(np.abs(both[i:, i]).argmax())
        both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, m:]


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x.astype(float))


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000, gap: float = 5e-4) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) such that every item is cut at least once: the revised simplex method over generated columns, rounded down, and the rest first fit decreasing.
    It stops when the program's value is within ``gap`` (or half a sequence) of the bound that the duals prove."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x, bound = times(inverse, demand), 0.0
    for r in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), sizes, capacity)
        bound = max(bound, float(demand @ np.maximum(duals, 0)) / max(value, 1))
        if value <= 1 + 1e-9 or x.sum() - bound <= max(0.5, gap * bound):
            break
        way = times(inverse, pattern)
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        if r % 200 == 199:
            inverse = inverse_of(basis)
        x = np.maximum(times(inverse, demand), 0)
    left, plan = demand.astype(int).copy(), []
    for j in np.argsort(-x):
        pattern = basis[:, j].round().astype(int)
        n = min([int(x[j] + 1e-9), *(left[pattern > 0] // pattern[pattern > 0])])
        if n > 0:
            plan.append((n, pattern))
            left -= n * pattern
    # At most one pattern's worth of items for each class is left; they go first fit decreasing, by whole runs.
    order = np.argsort(-sizes)
    while left.any():
        pattern, room = np.zeros(m, int), capacity
        for i in order:
            k = min(left[i], room // sizes[i])
            pattern[i] = k
            room -= k * sizes[i]
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        plan.append((n, pattern))
        left -= n * pattern
    return plan


def pack(docs: DataFrame, vocabulary: str, width: int = 2048, end_id: int = 1, step: int = 8) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece. ``vocabulary``: a path that every executor has."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(pieces_of(docs, vocabulary, width, end_id).withColumn("class", F.ceil(F.col("length") / step).cast("int")), "pieces")
    full_class = -(-width // step)
    histogram = {r["class"]: r["n"] for r in pieces.where(F.col("class") < full_class).groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_full = pieces.where(F.col("class") >= full_class).count()
    places, at = [], 0
    filled = Counter()
    if histogram:
        classes = np.array(sorted(histogram))
        for times, pattern in column_generation(classes, np.array([histogram[c] for c in classes], float), full_class):
            for c, k in zip(classes.tolist(), pattern.tolist(), strict=True):
                if k:
                    places.append((c, filled[c], filled[c] + times * k, at, k))
                    filled[c] += times * k
            at += times
    # As many rows as patterns times classes in one: bounded by width / step, whatever the number of documents.
    where = spark.createDataFrame(places, "class int, low long, high long, first long, each long")
    tails = pieces.where(F.col("class") < full_class)
    ranks = ranked(tails, ["class"], ["doc_id", "start", "ids_crc32"], "rank", sum(histogram.values()))
    seated = ranks.join(F.broadcast(where), "class").where("rank >= low and rank < high").withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div each"))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(W.unboundedPreceding, -1)
    seated = seated.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    whole = ranked(pieces.where(F.col("class") >= full_class).withColumn("all", F.lit(0)), ["all"], ["doc_id", "start", "ids_crc32"], "rank", n_full).withColumn("sequence_id", F.col("rank") + at).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return seated.select(*columns).unionByName(whole.select(*columns))
