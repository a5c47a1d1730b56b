"""Similar vectors, by random hyperplanes (rows that agree on all signs of one of several sets of planes are compared) or,
where no pair may be missed, by products of blocks of rows with each other."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.operators.ranks import written

SEED = 20250607
#: Numbers of a group of vectors, two of which are in one task; rows of a block of a group, whose products with another are held at a time.
GROUP_NUMBERS, BLOCK = 1 << 22, 512
#: Pairs of blocks that are settled at a time, and exact cosines that are.
PENDING, EXACT = 1 << 16, 1 << 11
#: What a product costs beside its numbers, and what a pair costs that it doesn't rule out, each in numbers of a product (as measured).
PRODUCT_COST, PAIR_COST = 15, 4000
#: Rows for each number of a vector from which turning them costs less than it saves.
TURNED = 32


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Sets of ``bits`` planes that find a pair at the threshold with a chance of ``recall``; more similar ones are found
    more surely. Two vectors at an angle are on the same side of a plane with a chance of 1 - angle / pi."""
    once = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return _numbers(column).astype(np.float64)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in doubles, added up one number after the other."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k].astype(np.float64) * y[:, k]
    return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One root of the product of squares: exact where rows hold quarters and the like, so that ties with the threshold count."""
    return _sums(x, y) / np.sqrt(_sums(x, x) * _sums(y, y))


def similar_pairs(vectors: DataFrame, threshold: float = 0.85, recall: float = 0.99, bits: int | None = None) -> DataFrame:
    """vectors: id, vector (of one length, without nulls). a < b, cosine: pairs at or above the threshold, each once.

    The index holds every row; what it proposes is compared exactly. It misses a pair at the threshold with a chance of
    1 - recall: the test measures it. ``bits`` grows with the rows so that a bucket keeps about 64 of them, and with it
    the number of sets. Give one row of each group of equal vectors (``firsts``): a bucket of copies has all pairs."""
    rows = vectors.where(F.exists("vector", lambda x: x != 0)).select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    first = rows.select(F.size("vector").alias("n")).first()
    if first is None:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine"))
    width, kind = first["n"], dict(rows.dtypes)["id"]
    bits = bits or min(24, max(8, (rows.count() // 64).bit_length()))
    tables = tables_for(threshold, bits, recall)
    # One number for each plane and dimension: some hundred kilobytes.
    planes = np.random.Generator(np.random.PCG64(SEED)).standard_normal((width, tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                signs = (_matrix(part.column(1)) @ planes > 0).reshape(part.num_rows, tables, bits) @ weights
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(signs.reshape(-1)), tables).cast(pa.list_(pa.int64()))], ["id", "signs"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column(2)), _matrix(b.column(3))
            dot = _cosines(x, y)
            keep = pa.array(dot >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(dot).filter(keep)], ["a", "b", "cosine"])

    signs = written(rows.mapInArrow(signed, f"id {kind}, signs array<long>"), "signs").select("id", F.posexplode("signs").alias("k", "s"))
    other = signs.select(F.col("id").alias("b"), "k", "s")
    # Ids alone meet; a bucket with very many rows is split like any skewed key of a join.
    met = signs.select(F.col("id").alias("a"), "k", "s").join(other, ["k", "s"]).where("a < b").select("a", "b").distinct()
    both = met.join(rows.select(F.col("id").alias("a"), F.col("vector").alias("x")), "a").join(rows.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compared, f"a {kind}, b {kind}, cosine double")


def firsts(vectors: DataFrame) -> DataFrame:
    """vectors: id, vector. class, vector: each vector once, and the smallest id that has it."""
    return vectors.groupBy("vector").agg(F.min("id").alias("class")).select("class", "vector")


def _places(flags: np.ndarray) -> np.ndarray:
    """Places of true flags; where they are few, by words of eight, then within these."""
    words = np.flatnonzero(flags.view(np.uint64) != 0)
    if len(words) * 16 > len(flags):
        return np.flatnonzero(flags)
    r, c = np.nonzero(flags.reshape(-1, 8)[words])
    return words[r] * 8 + c


def _turned(sides: list[np.ndarray], squares: list[np.ndarray], turn: bool = True) -> list[np.ndarray]:
    """Unit vectors along the rows, in single precision; with ``turn``, turned to the principal axes of all, so that the
    first numbers of a row hold the most of it. Their products are the cosines."""
    def units(v: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(v), 4096):
            yield at, v[at : at + 4096].astype(np.float64) / np.sqrt(s[at : at + 4096])[:, None]

    if turn:
        axes = np.linalg.eigh(sum(u.T @ u for side in zip(sides, squares, strict=True) for _, u in units(*side)))[1][:, ::-1]
    out = [np.empty(v.shape, np.float32) for v in sides]
    for to, *side in zip(out, sides, squares, strict=True):
        for at, u in units(*side):
            to[at : at + 4096] = u @ axes if turn else u
    return out


def _heads(turned: list[np.ndarray], floor: float) -> list[np.ndarray] | None:
    """The first numbers of rows and, as one more, the length of the rest: no product of two of these is less than that
    of the rows. As many numbers as rule out most pairs of some rows at the least cost; None: all."""
    def heads(rows: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([rows[:, :n], np.sqrt(np.einsum("ij,ij->i", rows[:, n:], rows[:, n:]))[:, None]], axis=1)

    width = turned[0].shape[1]
    some = [turned[0][:BLOCK], turned[-1][-BLOCK:]]
    costs = {width: width + PRODUCT_COST + PAIR_COST * np.mean(some[0] @ some[1].T >= floor) / 4}
    for n in range(max(1, width // 16), width - 1, max(1, width // 16)):
        costs[n] = n + 1 + PRODUCT_COST + PAIR_COST * np.mean(heads(some[0], n) @ heads(some[1], n).T >= floor)
    n = min(costs, key=costs.get)
    return None if n == width else [heads(t, n) for t in turned]


def _counted(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links and best cosine of each row of x, and of y, to rows of the other; ``same``: both are one group, in which each
    pair counts once for either row. No row is 0 or has squares beyond a double's range.

    Products in single precision are off by ``slack`` at most. They rule out pairs below the threshold by more, and
    count those above it by more; the exact cosine decides on the others, and is taken of all that may be a row's best."""
    sides = [x] if same else [x, y]
    squares = [_sums(v, v) for v in sides]
    width = x.shape[1]
    slack = (width + 8) * 2.0**-24
    links, best, top = ([np.full(len(v), e, k) for v in (x, y)] for e, k in ((0, np.int64), (-2.0, np.float64), (-2.0, np.float32)))
    if not len(x) or not len(y):
        return links, best
    many = sum(map(len, sides)) > TURNED * width
    turned = _turned(sides, squares, many)
    floor = np.float32(threshold - 2 * slack)
    heads = _heads(turned, floor) if many else None
    pending: list[tuple[np.ndarray, ...]] = []

    def settle() -> None:
        at, product = [np.concatenate([p[k] for p in pending]) for k in (0, 1)], np.concatenate([p[2] for p in pending])
        pending.clear()
        asked = np.abs(product - threshold) <= 2 * slack
        for side in (0, 1):
            np.maximum.at(top[side], at[side], product)
        for side in (0, 1):
            asked |= product >= top[side][at[side]] - 3 * slack
        held = np.ones(len(product), bool)
        asked = np.flatnonzero(asked)
        for part in range(0, len(asked), EXACT):
            k = asked[part : part + EXACT]
            p, q = at[0][k], at[1][k]
            cosine = _sums(x[p], y[q]) / np.sqrt(squares[0][p] * squares[-1][q])
            held[k] = link = cosine >= threshold
            for side, rows in ((0, p), (1, q)):
                np.maximum.at(best[side], rows[link], cosine[link])
        for side in (0, 1):
            np.add.at(links[side], at[side] if held.all() else at[side][held], 1)

    products, flags = np.empty(BLOCK * BLOCK, np.float32), np.zeros(-(-BLOCK * BLOCK // 8) * 8, bool)

    def reached(rows: list[np.ndarray], i: int, j: int) -> np.ndarray | None:
        """Places in a block with a product of at least ``floor``; None: too many to take one by one."""
        a, b = rows[0][i : i + BLOCK], rows[-1][j : j + BLOCK]
        product, flag = (buffer[: len(a) * len(b)].reshape(len(a), len(b)) for buffer in (products, flags))
        np.greater_equal(np.matmul(a, b.T, out=product), floor, out=flag)
        if same and i == j:
            flag[np.tril_indices(len(a))] = False
        if rows is heads and np.count_nonzero(flag) * PAIR_COST > flag.size * width:
            return None
        whole = -(-flag.size // 8) * 8
        flags[flag.size : whole] = False
        return _places(flags[:whole])

    waiting = 0
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            found = reached(heads, i, j) if heads else None
            if whole := found is None:
                found = reached(turned, i, j)
            if not len(found):
                continue
            # Quicker than divmod.
            r = found // (n := min(BLOCK, len(y) - j))
            r, c = i + r, j + found - r * n
            if whole:
                pending.append((r, c, products[found]))
            else:
                value = np.einsum("ij,ij->i", turned[0][r], turned[-1][c])
                near = value >= floor
                pending.append((r[near], c[near], value[near]))
            waiting += len(pending[-1][2])
            if waiting >= PENDING:
                settle()
                waiting = 0
    if pending:
        settle()
    return links, best


def counted_links(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """vectors: id, vector (of one length, without nulls), each id once. id, links (other rows with a cosine of at least
    the threshold), best (the greatest of these): rows that have any.

    All pairs are compared, so work grows with the square of the rows. They are dealt to groups, and each two groups meet
    in a task of their own, which holds a product of BLOCK rows with BLOCK others at a time and gives sums by row: no
    task holds more pairs than some blocks have, and its memory stays the same however many rows there are. Floats are
    sent as such. A row with a number that isn't finite has no links."""
    rows = vectors.where(F.exists("vector", lambda x: x != 0)).select("id", "vector")
    if dict(rows.dtypes)["vector"] != "array<float>":
        rows = rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    kind = dict(rows.dtypes)["id"]
    # Some three tasks for each core, where there are rows enough.
    wanted = math.ceil((math.sqrt(1 + 24 * rows.sparkSession.sparkContext.defaultParallelism) - 1) / 2)
    groups = max(1, math.ceil(n * (width or 1) / GROUP_NUMBERS), min(wanted, math.ceil(n / 1000)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(some) if (some := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        x = np.concatenate([_numbers(v) for v in table.column("vector").chunks])
        ids, table, some = table.column("id").combine_chunks(), table.drop_columns("vector"), None
        cells, groups = (table.column(c).to_numpy() for c in ("cell", "group"))
        squares = _sums(x, x)
        cells = np.where(np.isfinite(squares) & (squares > 0), cells, -1)
        for cell in np.unique(cells[cells >= 0]):
            own = np.flatnonzero(cells == cell)
            low = groups[own] == groups[own].min()
            # A cell of two groups has rows of both, but for empty ones; a group alone meets itself in the cell (k, k).
            k = int((math.isqrt(8 * int(cell) + 1) - 1) // 2)
            same = int(cell) == k * (k + 1) // 2 + k
            if not same and low.all():
                continue
            sides = [own, own] if same else [own[low], own[~low]]
            first = x[sides[0]]
            links, best = _counted(first, first if same else x[sides[1]], threshold, same)
            for side, n, cosine in zip(sides, links, best, strict=True):
                has = n > 0
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(side[has])), pa.array(n[has]), pa.array(cosine[has])], ["id", "links", "best"])

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    high = F.greatest("group", "other").cast("long")
    # The cells of two groups in a row: (0, 0), (0, 1), (1, 1), (0, 2) and so on.
    dealt = dealt.select("id", "vector", "group", (F.shiftright(high * (high + 1), 1) + F.least("group", "other")).cast("int").alias("cell"))
    met = dealt.repartitionById(groups * (groups + 1) // 2, "cell").mapInArrow(task, f"id {kind}, links long, best double")
    return met.groupBy("id").agg(F.sum("links").alias("links"), F.max("best").alias("best"))


def linked(vectors: DataFrame, threshold: float = 0.85, recall: float | None = None) -> DataFrame:
    """id, class, links (other classes with a similar vector), best (the greatest cosine to one of them). Without a
    ``recall`` no link is missed; with one, the index proposes the pairs."""
    least = written(firsts(vectors), "firsts")
    # With a number before them, vectors are sorted by it: comparing them element by element takes longer than all else.
    every, ones = (side.withColumn("hash", F.xxhash64("vector")) for side in (vectors, least))
    own = every.join(ones, ["hash", "vector"], "left").select("id", F.coalesce("class", "id").alias("class"))
    rows = least.withColumnRenamed("class", "id")
    if recall is None:
        counted = counted_links(rows, threshold).withColumnRenamed("id", "class")
    else:
        pairs = written(similar_pairs(rows, threshold, recall), "similar")
        both = pairs.select(F.col("a").alias("class"), "cosine").unionByName(pairs.select(F.col("b").alias("class"), "cosine"))
        counted = both.groupBy("class").agg(F.count(F.lit(1)).alias("links"), F.max("cosine").alias("best"))
    return own.join(counted, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "best")
