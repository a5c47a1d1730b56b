"""Operator 8: n-gram Jaccard self-join as a blocked sparse matrix product of the document by n-gram incidence.

Rows of the matrix are distinct sets of word shingles (equal sets are one row), columns are shingles, and an entry says
that a set holds a shingle. Two sets reach the similarity only if they share ``c`` = ceil(similarity * greater size)
columns, which bounds the work three times:

* Of any order of the columns, the first n - c + m of two such sets share at least m. With the order of the hashes and
  m = c / 8, a set that holds fewer than m shared columns among these links with nothing; most sets end here.
* The others' columns are counted exactly and put in order of these counts, rarest first. Only a set's first n - c + 1
  columns are multiplied, of which columns that no other set has need no entry.
* The first column that two sets share leaves each no more than its columns from there on to share.

Columns with the same rows are multiplied once. The product is accumulated in blocks: first each column pairs its rows
with one of them, twice; then, in each column, the rows outside its largest group of connected rows meet all rows
that are not connected with them. So a group of near copies, however large, costs about its rows, while no link between
different groups is lost. Overlaps of the pairs that are left are counted from the whole sets.

Null or empty text, or none but white space: no shingles, linked with nothing. Null doc_id: linked like any other, by
its text. Rows that share a doc_id are documents of their own. Repeated rows: one set. Empty table: no rows. Very long
texts: hashed in runs; a set is one row of at most as many numbers as the text has words. Columns other than doc_id
and text are ignored, unless named in ``keys``. A set is known by the sum of its shingles' 64-bit hashes, so of N
different sets N^2 / 2^65 pairs are expected to be taken for one: none to speak of among 10^9, some 270 among 10^11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import forget, small_batches, written
from .components import components
from .hashing import shingle_sets

#: Of the filter that says which documents' sets are wanted; false positives only cost time.
BUCKETS = 1 << 20
#: A column with at least a 1/HOT part of all entries is hot; there are HOT of these at most, so they may be broadcast.
HOT = 1 << 16
#: Bits of a set's sketch, and its columns.
SKETCH = 1024
SKETCHES = [f"p{i}" for i in range(SKETCH // 64)]


def sketched(s: np.ndarray) -> np.ndarray:
    """Each shingle turns one bit over. Two sketches differ in no more bits than their sets do in shingles: shingles of
    both turn the same bits in both."""
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_shared(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def extra(n: int, percent: int) -> int:
    """How many columns the first bound asks for. It grows no faster than ``least_shared``, as the bound needs."""
    return max(1, least_shared(n, percent) // 8)


def _identity(s: np.ndarray) -> int:
    return int(s.sum(dtype=np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def _signatures(docs: DataFrame, keys: list[str], words: int, percent: int) -> DataFrame:
    """doc_id, keys, n, d1 of each document's set, and its first columns in the order of the hashes."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = shingle_sets(b.column(b.num_columns - 1).to_pylist(), words)
                n = [len(s) for s in sets]
                first = _lists([s[: len(s) - least_shared(len(s), percent) + extra(len(s), percent)] for s in sets])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array([_identity(s) for s in sets], pa.int64()), first], [*b.schema.names[:-1], "n", "d1", "first"])

    kept = docs.select("doc_id", *keys, "text")
    return kept.mapInArrow(batches, kept.drop("text").schema.add("n", "long").add("d1", "long").add("first", ArrayType(LongType())))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, d1, n, columns of each document's whole set, and its sketch."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                found = shingle_sets(b.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_identity(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), _lists(found), *map(pa.array, np.stack([sketched(s) for s in found]).T.copy())], ["doc_id", "d1", "n", "columns", *SKETCHES])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id long, d1 long, n long, columns array<long>, {', '.join(f'{p} long' for p in SKETCHES)}")


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of the pairs (a, b), by their whole sets; in the JVM, so that no batch of sets is held beside them."""
    members = pairs.select(F.col("a").alias("d1")).unionByName(pairs.select(F.col("b").alias("d1"))).distinct()
    some = sets.select("d1", "columns").join(members, "d1", "left_semi")
    left, right = some.select(F.col("d1").alias("a"), F.col("columns").alias("x")), some.select(F.col("d1").alias("b"), F.col("columns").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.select("a", "b", (100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).alias("linked"))


def _shared(percent: int) -> Column:
    return F.expr(f"({percent} * n + 99) div 100")


def _open_sets(first: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """d1, n, columns and sketches of the sets that the first bound doesn't rule out."""
    some = first.where("n > 0").select("doc_id", "d1", "n", "first")
    entries = some.select("d1", F.explode("first").alias("column"))
    # A column whose entries are all of one set, copies included, is not shared.
    alone = entries.groupBy("column").agg(F.min("d1").alias("d1"), F.max("d1").alias("other")).where("d1 = other")
    alone = alone.groupBy("d1").agg(F.count(F.lit(1)).alias("alone"))
    c = _shared(percent)
    sizes = some.groupBy("d1", "n").agg(F.min("doc_id").alias("doc_id"))
    least = F.greatest(F.lit(1), F.expr(f"({percent} * n + 99) div 100 div 8"))
    live = written(sizes.join(alone, "d1", "left").where(F.col("n") - c + least - F.coalesce("alone", F.lit(0)) >= least).select("d1", "n", "doc_id"), "open")
    wanted = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    # At most BUCKETS rows of one integer.
    buckets = live.select(wanted.alias("bucket")).distinct()
    found = _sets(docs.join(F.broadcast(buckets), wanted == F.col("bucket"), "left_semi"), words)
    return written(found.join(live.select("d1", "n"), ["d1", "n"], "left_semi").select("d1", "n", "columns", *SKETCHES).dropDuplicates(["d1", "n"]), "sets")


def _matrix(sets: DataFrame, percent: int) -> DataFrame:
    """column, d1, n, at: each set's first columns from the rarest to the most frequent, of which others have some too;
    at: how many of the set's columns come before."""
    entries = sets.select("d1", "n", F.explode("columns").alias("column"))
    counts = written(entries.groupBy("column").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "column-counts")
    total = counts.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    is_hot = F.col("f") >= max(1000, total // HOT)
    hot = F.broadcast(counts.where(is_hot))
    shared = entries.join(hot, "column").unionByName(entries.join(hot, "column", "left_anti").join(counts.where(~is_hot), "column"))
    row = W.partitionBy("d1")
    placed = shared.select("d1", "n", "f", "column", (F.row_number().over(row.orderBy("f", "column")) - 1).alias("rank"), F.count(F.lit(1)).over(row).alias("others"))
    placed = placed.select("d1", "n", "f", "column", (F.col("n") - F.col("others") + F.col("rank")).alias("at")).where(F.col("at") <= F.col("n") - _shared(percent))
    placed = written(placed, "entries")
    # Of the columns with the same rows the first in the order is kept: rows share it first as well.
    same = placed.groupBy("column", "f").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("d1")).alias("s1"), F.bit_xor(F.xxhash64("d1", F.lit(1))).alias("s2")).where("rows > 1")
    one = same.groupBy("rows", "s1", "s2").agg(F.min(F.struct("f", "column")).alias("x")).select("x.column")
    out = written(placed.join(one, "column", "left_semi").select("column", "d1", "n", "at"), "matrix")
    forget(placed)
    forget(counts)
    return out


def grouped(docs: DataFrame, keys: list[str] | tuple = (), words: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, keys, n_shingles, component: one row per row of ``docs``; component is a number that connected documents
    share, null for those without words."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.coalesce("text", F.lit("")).alias("text"))
    whole = written(_signatures(docs, list(keys), words, percent), "signatures")
    slim = written(whole.drop("first"), "signed")
    sets = _open_sets(whole, docs, words, percent)
    forget(whole)
    matrix = _matrix(sets, percent)
    # Two sets must share so many shingles, and from their first shared column on they have no more than these.
    near = f"100 * least(m, n) >= {percent} * greatest(m, n) and least(n - at, m - c_at) >= ({percent} * (n + m) + {99 + percent}) div {100 + percent}"
    done, roots = None, None
    for r in range(rounds + 1):
        if roots is None:
            here = matrix.withColumn("root", F.col("d1"))
        else:
            here = written(matrix.join(roots, matrix["d1"] == roots["node"], "left").select("column", "d1", "n", "at", F.coalesce("root", "d1").alias("root")), "matrix-rooted")
        if r < rounds:
            centre = F.min(F.struct(F.xxhash64("d1", F.lit(r)).alias("turn"), F.col("d1").alias("c"), F.col("n").alias("m"), F.col("at").alias("c_at"), F.col("root").alias("c_root")))
            open_ = here.groupBy("column").agg(F.min("root").alias("low"), F.max("root").alias("high"), centre.alias("x")).where("low != high").select("column", "x.c", "x.m", "x.c_at", "x.c_root")
            paired = here.join(open_, "column").where(f"root != c_root and {near}")
        else:
            # The largest group of each column; the rows outside of it are what is left to pair.
            groups = here.groupBy("column", "root").agg(F.count(F.lit(1)).alias("size"))
            largest = groups.groupBy("column").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("column", "main")
            rows = here.join(largest, "column").join(sets.select("d1", *SKETCHES), "d1")
            left = rows.where("root != main").select("column", F.col("d1").alias("c"), F.col("n").alias("m"), F.col("at").alias("c_at"), F.col("root").alias("c_root"), *(F.col(p).alias(f"c_{p}") for p in SKETCHES))
            # Linked sets differ in no more shingles than this, so their sketches in no more bits.
            bits = " + ".join(f"bit_count({p} ^ c_{p})" for p in SKETCHES)
            paired = rows.join(left, "column").where(f"root != c_root and {near} and {bits} <= n + m - 2 * (({percent} * (n + m) + {99 + percent}) div {100 + percent})")
        pairs = paired.select(F.least("c", "d1").alias("a"), F.greatest("c", "d1").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(_overlaps(pairs, sets, percent), "overlaps")
        forget(pairs)
        done = found if done is None else done.unionByName(found)
        roots = written(components(done.where("linked").select("a", "b")), "roots")
    forget(sets)
    named = slim.join(roots, slim["d1"] == roots["node"], "left")
    return named.select("doc_id", *keys, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "d1")).alias("component"))


def join(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component); one row per row of ``docs``."""
    rows = written(grouped(docs, (), words, percent, rounds), "grouped")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # Copies of one set may be a third of all rows: the component side has one row each, and AQE splits the other.
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
