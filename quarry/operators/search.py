"""Substring search by trigram postings: a table that says which rows hold which three letters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.session import scratch

GRAM = 3


def grams(text: str) -> set[str]:
    """The distinct runs of three letters, as ``lower`` makes them."""
    low = text.lower()
    return {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}


class TrigramIndex:
    """Postings of a table's column, in files sorted by gram, so a search reads the parts that have its grams."""

    def __init__(self, table: DataFrame, key: str, column: str, folder: str | None = None):
        """Indexes ``table`` unless ``folder`` has an index already. Texts that are lower-cased to other lengths by
        different engines are the reason why the index proposes and the column itself decides."""
        self.table, self.key, self.column = table, key, column
        self.spark = table.sparkSession
        self.folder = folder or f"{scratch(self.spark)}/trigrams-{uuid.uuid4().hex}"
        kind = dict(table.dtypes)[key]

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    sets = [sorted(grams(x or "")) for x in part.column(1).to_pylist()]
                    rows = [i for i, g in enumerate(sets) for _ in g]
                    yield pa.RecordBatch.from_arrays([pa.array([x for g in sets for x in g], pa.string()), part.column(0).take(pa.array(rows, pa.int64()))], ["gram", key])

        postings = table.select(key, column).mapInArrow(post, f"gram string, {key} {kind}")
        # A gram that a third of all rows hold lies in many files: ranges are cut by row, too.
        postings.repartitionByRange(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "gram", key).sortWithinPartitions("gram", key).write.mode("ignore").option("parquet.block.size", 1 << 20).parquet(self.folder)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def search(self, needle: str) -> DataFrame:
        """The rows whose column holds ``needle``, letter case aside: candidates hold all its grams; the column decides.
        Needles below three letters are looked for in every row."""
        wanted = sorted(grams(needle))
        literal = needle.lower()
        found = F.contains(F.lower(F.col(self.column)), F.lit(literal))
        if not wanted:
            return self.table.where(found)
        hits = self.postings().where(F.col("gram").isin(wanted)).groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select(self.key)
        return self.table.join(hits, self.key, "left_semi").where(found)
