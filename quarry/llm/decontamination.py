"""Operator 9: benchmark decontamination by pigeonhole edit matching.

An item may differ from its place in a document by a budget of edits, a part of its length. Cut into budget + 1
pieces, at least one piece is there unchanged: an Aho-Corasick automaton finds all pieces' hits in the whole text,
and Myers' bit-parallel algorithm gives the edit distance of the item to the place around each hit.

Texts and items are compared with letters lower-cased and white space runs as one space. The budget is ``percent`` of an
item's length, rounded down: an item of fewer than 100 / percent characters must be there as it is. Null or blank texts
and items match nothing; an empty benchmark finds nothing and keeps every row. Repeated documents: each is searched;
repeated items (id and text): found once. Items that share an id, or have none, are items of their own: a document has
a row for each of them that it holds. ``start`` and ``end`` bound the place in the compared text (code points, end
exclusive): of the places of least distance the one that ends first, and of those that end there the shortest.
Benchmarks of any size: searched block by block, one pass over the documents for each block of ``block_chars``
characters. Very long texts: searched whole, one at a time, in memory that grows with that text. Other columns are
ignored by ``find`` and pass through ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, written

FOUND = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of near-equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any substring of ``text`` (anchored: to any that begins where the text
    does), and where such a substring ends first."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & full, down << 1 & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


class Searcher:
    def __init__(self, items: list[tuple[int | None, str]], percent: int):
        import ahocorasick

        self.items = [(t, len(t) * percent // 100) for _, t in items]
        self.ids = [i for i, _ in items]
        heads: dict[str, list[tuple[int, int]]] = {}
        for i, (t, budget) in enumerate(self.items):
            for offset, piece in pieces(t, budget):
                heads.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in heads.items():
            self.automaton.add_word(piece, (len(piece), where))
        if heads:
            self.automaton.make_automaton()
        self.empty = not heads

    def search(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of each item's nearest place within its budget; places in the normal text."""
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for i, offset in where:
                starts.setdefault(i, []).append(end + 1 - n - offset)
        out = []
        for i, at in starts.items():
            item, budget = self.items[i]
            exact = next((s for s in at if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                out.append((self.ids[i], 0, exact, exact + len(item)))
                continue
            if not budget:
                continue
            at = sorted(set(at))
            best, low, high = (budget + 1, 0, 0), at[0], at[0]
            for s in [*at[1:], None]:
                if s is not None and s - high <= 2 * budget:
                    high = s
                    continue
                a = max(0, low - budget)
                distance, end = myers(item, text[a : max(a, high + len(item) + budget)])
                if distance < best[0]:
                    best = (distance, a, a + end)
                if s is not None:
                    low = high = s
            distance, a, end = best
            if distance <= budget:
                # Read backwards from its end, the place begins where the distance is reached first.
                _, length = myers(item[::-1], text[a:end][::-1], anchored=True)
                out.append((self.ids[i], distance, end - length, end))
        return out


def blocks(benchmark: DataFrame, percent: int, block_chars: int) -> Iterator[Block]:
    """Blocks of at most about ``block_chars`` characters of items, which are dealt to them by hash. One is made at a
    time: the driver and the tasks hold no more than one block's items."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("trim(text) != ''").distinct()
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        held = list(dict.fromkeys((r["item_id"], t) for r in rows if (t := normal(r["text"]))))
        if held:
            yield Block(held, percent, n == 1)


class Block:
    """Travels to the executors as its items; each worker builds the automaton once."""

    built: dict = {}

    def __init__(self, items: list[tuple[int | None, str]], percent: int, alone: bool = True):
        self.items, self.percent, self.alone, self.key = items, percent, alone, (percent, hash_of(items))

    def searcher(self) -> Searcher:
        if self.key not in Block.built:
            if len(Block.built) >= 2:
                Block.built.clear()
            Block.built[self.key] = Searcher(self.items, self.percent)
        return Block.built[self.key]


def hash_of(items: list[tuple[int | None, str]]) -> str:
    import hashlib

    return hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()


def find(docs: DataFrame, benchmark: DataFrame, percent: int = 5, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, distance, start, end: one row for each document and item that it holds."""
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, percent, block_chars):

        def batches(rows: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = block.searcher().search
            for b in rows:
                found = [(d, *x) for d, t in zip(b.column(0).to_pylist(), (t.as_py() for t in b.column(1)), strict=True) for x in search(normal(t))]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "distance", "start", "end"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, FOUND)
        if not block.alone:  # written, so that no later block is held together with this one
            part = written(part, "found")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 5, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, percent, block_chars):

        def batches(rows: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = block.searcher().search
            for b in rows:
                keep = pa.array([not search(normal(t.as_py())) for t in b.column(at)], pa.bool_())
                yield pc.filter(b, keep) if isinstance(b, pa.Table) else b.filter(keep)

        docs = docs.mapInArrow(batches, docs.schema)
        if not block.alone:
            docs = written(docs, "clean")
    return docs
