"""Operator 5: byte-pair token counts by a heap of adjacent pairs over a linked list of symbols.

A word's count is its bytes minus its merges; no identifiers are emitted. Words are split by the byte-level pattern that
is fixed here; a tokenizer file with a normaliser or another kind of splitter is refused. Special strings count as one
token each. Each Python worker keeps the counts of
words it has met in a dictionary of bounded size. Null text: empty. Empty table: no rows. Repeated rows: counted each.
Columns other than doc_id and text are ignored. A word of any length costs n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: The byte-level word pattern of the vocabulary; \s spelt out as the Unicode white space.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r\x20A-Za-z0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+"
WORDS_KEPT = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    out |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class PairMerger(dict):
    """Word to number of tokens, worked out on first sight."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path}: not split by the byte-level pattern alone")
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.merge = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.words, self.ascii_words = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def count_word(self, word: str) -> int:
        ids = [self.first[b] for b in word.encode("utf-8", "surrogatepass")]
        n, merge = len(ids), self.merge
        if n < 2:
            return n
        heap = [(m, i) for i in range(n - 1) if (m := merge.get(ids[i] << 20 | ids[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            # A dead or changed pair no longer looks up to the same merge.
            if ids[i] < 0 or j >= n or merge.get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := merge.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := merge.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (x, h))
        return n - merges

    def __missing__(self, word: str) -> int:
        n = self.count_word(word)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = n
        return n

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.ascii_words(text) if text.isascii() else self.words(text)))

    def count(self, text: str) -> int:
        if self.special and any(m in text for m in self.marks):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)


_mergers: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    if path not in _mergers:
        _mergers[path] = PairMerger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row of ``docs``. ``vocabulary`` is a path that every executor has."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(vocabulary).count
        for b in rows:
            n = [count(t) if t else 0 for t in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
