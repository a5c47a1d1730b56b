"""From documents to packed training sequences: each stage's rows are written and read again by the next.

Each of the filtering stages keeps or drops whole rows, with all their columns. Rows are told apart by the place in the
file that they are read from, so rows that share a doc_id, or have none, are decided each on its own. Null text counts
as an empty one, of which exact dedup leaves one row; texts of any length are read whole; equal texts, and near ones,
leave one row each. Without labels of both kinds, or without benchmark items, those stages keep every row; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import decontamination, ngram_join, packing, quality
from quarry.llm.common import forget, numbered, row_names, shared_dir, table, written
from quarry.llm.queries import deduplicated, vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def without(docs: DataFrame, gone: DataFrame, row: tuple[str, str]) -> DataFrame:
    """The rows of ``docs`` whose numbers, ``row``, are not among those of ``gone``."""
    return docs.join(gone.select(*row), list(row), "left_anti").drop(*row)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the smallest doc_id that is not null; of several rows with that id, the first by its number."""
    row = row_names(docs)
    docs = numbered(docs, row)
    judged = deduplicated(docs, row)
    first = judged.where("kept").groupBy("text_sha256").agg(F.min(F.struct(*row)).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = judged.where("kept").join(first, "text_sha256").where(F.struct(*row) != F.col("first"))
    return without(docs, judged.where("not kept").select(*row).unionByName(again.select(*row)), row)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the smallest doc_id that is not null, then the first by its number. Rows without words stay."""
    row = row_names(docs)
    docs = numbered(docs, row)
    found = written(ngram_join.grouped(docs, row), "pipeline-groups").where("component is not null")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *row)
    first = found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return without(docs, found.join(first, "component").where(order != F.col("first")), row)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("exact dedup", distinct_texts), ("n-gram Jaccard join", distinct_groups), ("benchmark decontamination", uncontaminated), ("packing", packed)]
#: A classifier and a packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:  # the stage before is written out in full: its rows are read no more
            forget(docs)
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
