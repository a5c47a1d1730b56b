"""Operator 11: token ids as Arrow stream files of fixed-size-list batches, read without copies at any place.

Documents are dealt to ranges of doc_id, and each range is tokenised and written by its task, one document after the
other, as files of its own: ``tokens-PPPPP-KKKK.arrows``, an Arrow IPC stream whose batches all have the same
number of sequences (the last may have fewer), and each sequence ``width`` ids and as many mask bits: 1 for an id, 0
for padding, which only a file's last sequence has. Nothing in a batch varies in length, so all batches take the same
bytes, and a sequence's place in the file follows from its number: ``TokenFile`` maps a file and hands out ids and masks
as views of it (masks as Arrow's bits). Beside each file ``...docs.arrows`` names its documents: doc_id, start (in the file) and n_tokens. A
document never crosses files; a file ends with the first document
that brings it to ``file_sequences``, or to FILE_DOCS documents. Files get their
name when they are whole, so a task that is run again, or twice, leaves the same ones.

Order: ascending doc_id, null ids last, rows that share an id by size and hash of their texts. Null text: no ids but
the end. Empty table: no files, no rows. Repeated rows: a document each. Very long texts: one text's ids held at a time,
and one batch written at a time. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import ROW, numbered, shared_dir, written
from .packing import WordIds

#: Bytes of text that one range, and so one task, is to tokenise and write. There are at most MAX_PARTS ranges.
PART_BYTES, MAX_PARTS = 1 << 26, 100_000
#: Documents of a file: their list is held until the file ends.
FILE_DOCS = 1 << 19
FILES = "part int, file int, name string, n_docs long, n_tokens long, n_sequences long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, file_start long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_tokenizers: dict[str, WordIds] = {}


def tokenised(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids, the end id last, of each row (doc_id, text)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = WordIds(vocabulary)
    known, end = _tokenizers[vocabulary], np.asarray([end_id], "<u4").tobytes()
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            raw = [t or "" for t in part.column(1).to_pylist()]
            found = known.look_up([known.split(t) for t in raw])
            for doc_id, text, ids in zip(part.column(0).to_pylist(), raw, found, strict=True):
                yield doc_id, np.frombuffer((known.whole(text) if ids is None else b"".join(ids)) + end, "<u4")
    known.clear()
    pa.default_memory_pool().release_unused()


def _schema(width: int, dtype: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), width)), ("mask", pa.list_(pa.bool_(), width))])


class TokenFileWriter:
    """One file and its list of documents. ``add`` takes a document's ids; at most one batch is held."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, width: int, batch: int, dtype: str):
        self.fs, self.path, self.width, self.batch, self.dtype = fs, path, width, batch, np.dtype(dtype)
        self.schema, self.docs, self.n_tokens = _schema(width, dtype), ([], [], []), 0
        self.draft = f"{path}.{uuid.uuid4().hex}.part"
        self.sink = fs.open_output_stream(self.draft)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.ids, self.filled = np.zeros(batch * width, self.dtype), 0

    def _flush(self) -> None:
        n = -(-self.filled // self.width)
        if n:
            mask = np.arange(n * self.width) < self.filled
            self.ids[self.filled :] = 0
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (self.ids[: n * self.width], mask)]
            self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, v in zip(self.docs, (doc_id, self.n_tokens, len(ids)), strict=True):
            column.append(v)
        self.n_tokens += len(ids)
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.ids) - self.filled)
            self.ids[self.filled : self.filled + n] = ids[at : at + n]
            self.filled, at = self.filled + n, at + n
            if self.filled == len(self.ids):
                self._flush()

    def close(self) -> tuple[int, int, int]:
        """The numbers of documents, ids and sequences. The list of documents goes first: who sees a file has both."""
        self._flush()
        self.stream.close()
        self.sink.close()
        with self.fs.open_output_stream(f"{self.draft}.docs") as sink, pa.ipc.new_stream(sink, DOCS) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.docs], schema=DOCS))
        self.fs.move(f"{self.draft}.docs", docs_of(self.path))
        self.fs.move(self.draft, self.path)
        return len(self.docs[0]), self.n_tokens, -(-self.n_tokens // self.width)


def docs_of(path: str) -> str:
    return path.removesuffix(".arrows") + ".docs.arrows"


class TokenFile:
    """A written file. ``sequence(i)``: ids and mask of the i-th sequence, read where they lie: views of the mapped
    file where it is local, else of one batch's bytes."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.fs, self.path = fs, path
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.width = self.schema.field("ids").type.list_size
        self.first = self.source.tell()
        start = self._batch_at(self.first)
        # The first batch tells how many bytes and sequences every batch has.
        self.step, self.batch = (self.source.tell() - self.first, start.num_rows) if start is not None else (0, 0)

    def _batch_at(self, place: int) -> pa.RecordBatch | None:
        self.source.seek(place)
        try:
            return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        except EOFError:
            return None

    def batches(self) -> Iterator[pa.RecordBatch]:
        for place in itertools.count(self.first, self.step) if self.step else ():
            b = self._batch_at(place)
            if b is None:
                return
            yield b

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        b = self._batch_at(self.first + i // self.batch * self.step) if i >= 0 and self.step else None
        if b is None or i % self.batch >= b.num_rows:
            raise IndexError(i)
        ids, mask = (b.column(c).flatten().slice(i % self.batch * self.width, self.width) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def docs(self) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(docs_of(self.path)) as source:
            yield from pa.ipc.open_stream(source)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, start and the ids, in runs, of each document in turn; the runs must be read before the next one."""
        batches = self.batches()
        ids = np.empty(0, np.uint32)

        def runs(n: int) -> Iterator[np.ndarray]:
            nonlocal ids
            while n:
                if not len(ids):
                    b = next(batches)
                    ids = b.column(0).flatten().to_numpy(zero_copy_only=True)[: b.column(1).flatten().true_count]
                run, ids = ids[:n], ids[n:]
                n -= len(run)
                yield run

        for b in self.docs():
            for doc_id, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield doc_id, start, runs(n)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, width: int = 2048, batch: int = 64, file_sequences: int = 1 << 15, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes the files into ``folder``, an address that Arrow's file systems and every executor can open, and returns
    their list (FILES), in whose order (part, file) the documents ascend."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    dtype = "<u2" if max([end_id, *Tokenizer.from_file(vocabulary).get_vocab().values()]) < 1 << 16 else "<u4"
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = docs.agg(F.coalesce(F.sum(size + 1), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, min(MAX_PARTS, -(-total // part_bytes)))

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, done, out = TaskContext.get().partitionId(), [], None
        for doc_id, ids in tokenised(rows, vocabulary, end_id):
            out = out or TokenFileWriter(fs, f"{root}/tokens-{part:05d}-{len(done):04d}.arrows", width, batch, dtype)
            out.add(doc_id, ids)
            if out.n_tokens >= file_sequences * width or len(out.docs[0]) >= FILE_DOCS:
                done.append((part, len(done), os.path.basename(out.path), *out.close()))
                out = None
        if out:
            done.append((part, len(done), os.path.basename(out.path), *out.close()))
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["part", "file", "name", "n_docs", "n_tokens", "n_sequences"])

    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # Rows alike are told apart by their place, so that a range may end between them.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), size, F.xxhash64("text"), *ROW]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(ranges.select("doc_id", "text").mapInArrow(task, FILES), "token-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """Every document as the files have it: READ, ``start`` counting the ids of all documents before it, ``file_start``
    those of its file."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for b in rows:
            for name, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                documents = TokenFile(fs, f"{root}/{name}").documents()
                while some := list(itertools.islice(map(_summed, documents), 10_000)):
                    doc_id, start, n, crc = (pa.array(c, pa.int64()) for c in zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([doc_id, pc.add(start, before), n, crc, pa.array([name] * len(some)), start], ["doc_id", "start", "n_tokens", "ids_crc32", "file", "file_start"])

    # One row a range, of which there are at most MAX_PARTS.
    sums, at = [], 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        sums.append((r["part"], at))
        at += r["n"]
    parts = F.broadcast(files.sparkSession.createDataFrame(sums, "part int, before long"))
    earlier = W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    places = files.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(parts, "part")
    return places.select("name", F.col("before") + F.col("earlier")).repartition(max(1, min(len(sums), MAX_PARTS))).mapInArrow(task, READ)


def _summed(document: tuple[int | None, int, Iterator[np.ndarray]]) -> tuple[int | None, int, int, int]:
    doc_id, start, runs = document
    n = crc = 0
    for run in runs:
        n, crc = n + len(run), zlib.crc32(run.astype("<u4").tobytes(), crc)
    return doc_id, start, n, crc


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """The documents as files in the shared folder have them. The files stay: they are what the operator is for."""
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    return read(write(docs, vocabulary, folder), folder)
