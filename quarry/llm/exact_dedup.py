"""Operator 7: exact duplicates against a persistent digest index, in DataFrame operations only.

The index is a table bucketed by digest, each bucket sorted by it, with one partition for each batch that was added:
a row for each digest that the batch brought (``fresh``, with the smallest doc_id of the batch) or met again, and the
batch's copies. New data is deduplicated by a sort-merge anti-join with the earlier batches: the index side is read in
its buckets, without a shuffle (Spark sorts them anew, as it doesn't trust files to be sorted). Adding a batch again
replaces its partition and is decided by the same earlier batches, so a retry changes nothing.

Texts are equal when identical after each run of white space becomes one space; null counts as empty. Of equal texts
the smallest doc_id of the earliest batch stays. Null doc_id: never stays unless all of a text's ids in its first batch
are null. Repeated rows share one decision. Empty table: no rows. Very long texts: one digest like any other. Columns
other than doc_id and text are ignored, unless named in ``keys``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACE, forget, written

#: At most so many groups are hot: each holds at least a 1/HOT part of the rows, so the broadcast is bounded.
HOT = 1000
#: An index is made with about so many rows in a bucket, in LEAST buckets or more, and no more than Spark allows.
BUCKET_ROWS, LEAST, MOST = 4_000_000, 32, 100_000
INDEX = "digest binary, first_id long, copies long, fresh boolean, batch long"


def digest(text) -> F.Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


def buckets_for(rows: int) -> int:
    """How many buckets an index of so many rows should have: each is one task's sort."""
    return min(MOST, max(LEAST, -(-rows // BUCKET_ROWS)))


class DigestIndex:
    """``name``: a table in the session's warehouse, which all executors must share on a cluster. ``buckets`` is for the
    rows that the index shall hold (``buckets_for``) and fixed when it is made; one that exists keeps its own."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = LEAST):
        self.spark, self.name, self.buckets = spark, name, buckets
        if spark.catalog.tableExists(name):
            self.buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
        else:
            empty = spark.createDataFrame([], INDEX)
            empty.write.partitionBy("batch").bucketBy(buckets, "digest").sortBy("digest").format("parquet").saveAsTable(name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def next_batch(self) -> int:
        last = self.rows().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def add_digests(self, slim: DataFrame, batch: int | None = None) -> int:
        """Adds the rows of ``slim`` (doc_id, digest) as one batch, and returns its number. A number that was given
        before replaces that batch."""
        batch = self.next_batch() if batch is None else batch
        groups = slim.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        known = self.rows().where((F.col("batch") < batch) & F.col("fresh")).select("digest")
        new = groups.join(known.hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
        met = groups.join(known.hint("merge"), "digest", "left_semi").withColumn("fresh", F.lit(False))
        # Written apart first: a partition can't be replaced by what is read from its own table.
        rows = written(new.unionByName(met), "digest-batch")
        dealt = rows.repartition(self.buckets, "digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch}) SELECT digest, first_id, copies, fresh FROM {{dealt}}", dealt=dealt)
        forget(rows)
        return batch

    def decided(self, slim: DataFrame) -> DataFrame:
        """digest, keep_id, copies, here: what the index says of each digest of ``slim``; written."""
        here = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("here"))
        # The first batch of a digest says what stays; all of them count.
        known = self.rows().groupBy("digest").agg(F.min_by("first_id", "batch").alias("keep_id"), F.sum("copies").alias("copies"))
        return written(known.join(here.hint("merge"), "digest"), "digests-decided")

    def decide_digests(self, slim: DataFrame, keys: list[str] | tuple = (), decided: DataFrame | None = None) -> DataFrame:
        """doc_id, keys, keep_id, group_size (all copies in the index), kept, text_sha256: one row per row of ``slim``,
        whose digests the index must have."""
        decided = self.decided(slim) if decided is None else decided
        rows = slim.count()
        # Copies of one text may be a third of all rows: hot groups are few, so they are broadcast, the rest is merged.
        # Their rows in ``slim`` count, not those in the index: at most HOT groups hold a 1/HOT part of these.
        is_hot = F.col("here") >= max(HOT, rows // HOT)
        hot, cold = F.broadcast(decided.where(is_hot).drop("here")), decided.where(~is_hot).drop("here")
        out = slim.join(hot, "digest").unionByName(slim.join(hot, "digest", "left_anti").join(cold.hint("merge"), "digest"))
        return out.select("doc_id", *keys, "keep_id", F.col("copies").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def add(self, docs: DataFrame, batch: int | None = None, keys: list[str] | tuple = ()) -> DataFrame:
        """Adds the documents as one batch and decides on each of them."""
        slim = written(slim_of(docs, keys), "digests")
        self.add_digests(slim, batch)
        return self.decide_digests(slim, keys)


def slim_of(docs: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, digest(F.col("text")).alias("digest"))


def deduplicate(docs: DataFrame, name: str, batches: int = 2, keys: list[str] | tuple = (), buckets: int | None = None) -> DataFrame:
    """Decisions on a whole table by an index of its own, ``name``, to which it is added in batches of ascending doc_id:
    later batches are decided by the anti-join with earlier ones, and the smallest doc_id of a text comes first. Null
    ids come last. The index has buckets for the table's rows, unless ``buckets`` says otherwise; it is dropped, and what
    was written on the way deleted, once its decisions are written."""
    spark = docs.sparkSession
    slim = written(slim_of(docs, keys), "digests")
    index, decided = DigestIndex(spark, name, buckets or buckets_for(slim.count())), None
    try:
        cuts = slim.where("doc_id is not null").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.02) if batches > 1 else []
        batch = F.lit(0)
        for cut in cuts:
            batch = batch + F.when(F.col("doc_id") > int(cut), 1).otherwise(0)
        batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(batch)
        for k in range(batches):
            index.add_digests(slim.where(batch == k), k)
        decided = index.decided(slim)
        return written(index.decide_digests(slim, keys, decided), "digests-rows")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for part in (slim, decided):
            if part is not None:
                forget(part)
