"""Operator 12: conversations made well-formed by a scan of min-plus matrices.

A conversation is well-formed when it is empty, or an optional system turn and then pairs of user and assistant. Its
grammar has four states: begun, after the system turn, after a user's turn, after an assistant's. Each turn is a 4x4
matrix whose element (i, j) is the cheapest way, as (cost, audit), from state i to j over that turn: any inserted turns
first, then the turn kept, reroled or deleted. Sums are minima, of equal costs the ASCII-least audit; products add costs
and join audits. Inserted turns stand before a turn, never after it, so no two audits of an element are a prefix of one
another (both have as many other letters and end with one), minima are the same before and after joining, and products
may be bracketed at will.

Turns are sorted over all conversations at once and cut into ranges, so a conversation of any length lies in as many
tasks as it needs. A task multiplies its run of each conversation as a tree, and the runs of conversations that reach
over its edges meet in rounds of FAN neighbours. What comes out is a row for each conversation; ``repaired`` then streams
its turns past its audit, and ``digests`` hashes what it yields.

Order: by turn, null first, turns that share a number by the SHA-256 of role and text. Null role or text: one space, so a
null text is blank. Null conv_id: a conversation like any other. Repeated rows: turns of their own, of which all but the
first are duplicates. Very long texts: digests and flags alone are sorted and multiplied; texts move once, to be hashed.
Empty table: no rows. Columns other than conv_id, turn, role and text are ignored. SHA-256 chains its blocks, so
``digests`` and ``repaired`` stream a conversation through one task, whose memory holds its audit and one batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, forget, numbered, written

BEGUN, SYSTEM, USER, ASSISTANT = range(4)
STATES, FAN = 4, 16
#: White space of the contract, as characters to trim.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Flags of a turn.
MUST_GO, CUT = 4, 8
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")
#: A run of a conversation's turns: its edges, counts and matrix; of a whole conversation cost and audit alone.
RUN = "conv_id long, part int, open boolean, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
RUN_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("open", pa.bool_()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "turns", *COUNTS)), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORT_ARROW = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string())])
REPAIRED = "conv_id long, place long, edit string, role string, text string"
REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]
IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(STATES) for j in range(STATES))


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(0, STATES * STATES, STATES):
        for j in range(STATES):
            best = None
            for k in range(STATES):
                x, y = a[i + k], b[STATES * k + j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    both = (x[0] + y[0], x[1] + y[1])
                    if best is None or both < best:
                        best = both
            out.append(best)
    return tuple(out)


def inserts() -> Matrix:
    """The closure of inserted turns: a user's after anything but a user's, an assistant's after that."""
    one = list(IDENTITY)
    for i, j in ((BEGUN, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        one[STATES * i + j] = (5, "I")
    return product(tuple(one), tuple(one))


CLOSURE = inserts()


@lru_cache(None)
def matrix(turn: int) -> Matrix:
    """Of a turn: its sort of role (0 system, 1 user, 2 assistant, 3 any other), with MUST_GO for a blank or repeated one and CUT for a truncated one."""
    sort, cut = turn & 3, 5 if turn & CUT else 0
    ways = {(i, i): (2, "D") for i in range(STATES)}

    def way(i: int, j: int, cost: int, letter: str) -> None:
        ways[i, j] = min(ways.get((i, j), (99, "")), (cost + cut, letter))

    if not turn & MUST_GO:
        for i in (BEGUN, SYSTEM, ASSISTANT):
            way(i, USER, 1, "R")
        way(USER, ASSISTANT, 1, "R")
        if sort == 0:
            way(BEGUN, SYSTEM, 0, "K")
        elif sort == 1:
            for i in (BEGUN, SYSTEM, ASSISTANT):
                way(i, USER, 0, "K")
        elif sort == 2:
            way(USER, ASSISTANT, 0, "K")
    return product(CLOSURE, tuple(ways.get((i, j)) for i in range(STATES) for j in range(STATES)))


@lru_cache(1 << 16)
def block(turns: tuple[int, ...]) -> Matrix:
    """Of up to four turns; of the few kinds of turns there are few such blocks."""
    half = len(turns) // 2
    return matrix(turns[0]) if len(turns) == 1 else product(block(turns[:half]), block(turns[half:]))


class Tree:
    """A product of turns from left to right, as a tree whose halves are of like size: what is held is the product of
    each full subtree, so joining audits takes n log n steps."""

    def __init__(self):
        self.waiting: list[int] = []
        self.full: list[tuple[int, Matrix]] = []

    def add(self, turn: int) -> None:
        self.waiting.append(turn)
        if len(self.waiting) == 4:
            self._close()

    def _close(self) -> None:
        size, m = 1, block(tuple(self.waiting))
        while self.full and self.full[-1][0] == size:
            size, m = 2 * size, product(self.full.pop()[1], m)
        self.full.append((size, m))
        self.waiting = []

    def whole(self) -> Matrix:
        out = block(tuple(self.waiting)) if self.waiting else None
        for _, m in reversed(self.full):
            out = m if out is None else product(m, out)
        return out or IDENTITY


def cheapest(m: Matrix) -> tuple[int, str]:
    """Of all ways from the beginning to an end, with what is inserted last."""
    row = product(m, CLOSURE)
    return min(x for x in (row[BEGUN], row[ASSISTANT]) if x is not None)


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\x00", F.col("role"), F.col("text")).cast("binary"), 256))


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, without nulls in role and text."""
    blank = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).withColumn("digest", _digest())


def _marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, ROW, sort, initial and flags of every turn. Turns alike are counted first, so that only
    those that have a like are joined, with the first of them."""
    trimmed = F.btrim(F.col("text"), F.lit(BLANKS))
    slim = turns_of(rows).select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("cut"))
    slim = numbered(written(slim, "turns"))
    place = F.struct("turn", *ROW)
    alike = slim.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    met = slim.join(alike, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))
    sort = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    return met.select("conv_id", "turn", "digest", *ROW, "initial", sort.alias("sort"), fault.alias("fault"))


class _Run:
    """What one task has seen of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.first, self.last, self.low, self.high, self.turns = conv, None, None, None, None, 0
        self.counts, self.tree = [0, 0, 0, 0], Tree()

    def add(self, turn: int | None, initial: str, sort: int, fault: int) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.counts[3] += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault:
            self.counts[fault - 1] += 1
        self.tree.add(sort | (MUST_GO if fault in (1, 2) else CUT if fault == 3 else 0))

    def row(self, part: int, edge: bool) -> tuple:
        m = self.tree.whole()
        elements = m if edge else [cheapest(m)]
        return (self.conv, part, edge, self.first, self.last, self.low, self.high, self.turns, *self.counts, [x and x[0] for x in elements], [x and x[1] for x in elements])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to a RUN row for each conversation; the task's first and last may go on in its neighbours."""
    part, now, first, out, held = TaskContext.get().partitionId(), None, True, [], 0
    for b in rows:
        for conv, turn, initial, sort, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row(part, first))
                    first, held = False, held + len(out[-1][-1][0])
                    if len(out) >= 2000 or held > 1 << 20:
                        yield _batch(out, RUN_ARROW)
                        out, held = [], 0
                now = _Run(conv)
            now.add(turn, initial, sort, fault)
    if now is not None:
        yield _batch([*out, now.row(part, True)], RUN_ARROW)


def _elements(run: dict) -> Matrix:
    return tuple(None if a is None else (c, a) for c, a in zip(run["costs"], run["audits"], strict=True))


def _joined(runs: pa.Table) -> pa.Table:
    """Neighbouring runs of one conversation as one."""
    rows = sorted(runs.to_pylist(), key=lambda r: r["part"])
    one, products = rows[0], [_elements(r) for r in rows]
    while len(products) > 1:
        products = [product(*products[i : i + 2]) if i + 1 < len(products) else products[i] for i in range(0, len(products), 2)]
    for r in rows[1:]:
        one["illegal"] += r["illegal"] + (one["last"] + r["first"] not in LEGAL)
        one["last"] = r["last"]
        for c in ("blank", "duplicate", "truncated"):
            one[c] += r[c]
        if r["low"] is not None:
            one["turns"] += r["turns"] - (one["high"] == r["low"])
            one["low"] = r["low"] if one["low"] is None else one["low"]
            one["high"] = r["high"]
    one["costs"], one["audits"] = [x and x[0] for x in products[0]], [x and x[1] for x in products[0]]
    return pa.Table.from_pylist([one], RUN_ARROW)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            cost, audit = _elements(r)[0] if len(r["costs"]) == 1 else cheapest(_elements(r))
            gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
            out.append((r["conv_id"], gaps, *(r[c] for c in COUNTS), cost, audit))
        if out:
            yield _batch(out, REPORT_ARROW)


def judge(rows: DataFrame, run_rows: int = 1 << 20) -> DataFrame:
    """REPORT: a row for each conversation of ``rows`` (conv_id, turn, role, text). A task's range has about ``run_rows``
    turns, or fewer where the session's shuffles have more partitions."""
    spark = rows.sparkSession
    marked = written(_marked(rows), "turns-marked")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // run_rows))
    order = ["conv_id", "turn", "digest", *ROW]
    ranges = marked.repartitionByRange(parts, *order)
    # Every range is a partition of its own, numbered in order, also where more are made than were asked for.
    runs = written(ranges.sortWithinPartitions(*order).select("conv_id", "turn", "initial", "sort", "fault").mapInArrow(_runs, RUN), "runs")
    forget(marked)
    most = runs.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    whole, open_, span = runs.where("not open"), runs.where("open"), 1
    # At most two rows a task are open, and FAN of them meet in a group.
    while span < most:
        span *= FAN
        open_ = written(open_.groupBy("conv_id", F.expr(f"part div {span}")).applyInArrow(_joined, RUN), "runs-joined")
    return whole.unionByName(open_).mapInArrow(_reports, REPORT)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's audit, then its turns in order, to the turns that stay or come."""
    out, held, conv, audit, at, place, state = [], 0, None, "", 0, 0, BEGUN

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place, state, held
        out.append((conv, place, edit, role, text))
        place, held = place + 1, held + len(text)
        state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT

    def due() -> str:
        return "assistant" if state == USER else "user"

    def inserted() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("I", due(), "")
            at += 1

    for b in batches:
        for key, head, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if head is not None:
                inserted()
                conv, audit, at, place, state = key, head, 0, 0, BEGUN
                continue
            inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(edit, due() if edit == "R" else role, text)
            if len(out) >= 1000 or held > 1 << 23:
                yield _batch(out, REPAIRED_ARROW)
                out, held = [], 0
    inserted()
    if out:
        yield _batch(out, REPAIRED_ARROW)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """REPAIRED: the turns of ``rows`` as ``reports``, which judged them, mends them; each conversation's lie together,
    in order, in one partition."""
    turns = turns_of(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", F.lit(None).cast("string").alias("audit"), "role", "text")
    none = {"turn": "long", "digest": "binary", "role": "string", "text": "string"}
    heads = reports.select("conv_id", F.lit(0).alias("kind"), "audit", *(F.lit(None).cast(k).alias(c) for c, k in none.items()))
    dealt = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(_repairs, REPAIRED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of what ``repaired`` gave: its ``role:text`` lines. Conversations without turns have none."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, now = None, None
        for b in batches:
            convs, shas = [], []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        convs.append(now)
                        shas.append(sha.hexdigest())
                    sha, now = hashlib.sha256(), conv
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(shas, pa.string())], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
