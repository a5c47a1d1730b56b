"""One query for each operator, over its whole table, with production parameters; and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, decontamination, hard_negatives, lm_scoring, ngram_join, packing, pii, quality, sharding, token_counts, token_files, url_filter
from .common import table, written
from .exact_dedup import deduplicate


def vocabulary(name: str) -> str:
    """Where the public tokenizer files are; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pair_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def deduplicated(docs: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """Decisions on ``docs`` by an index of their own."""
    return deduplicate(docs, f"digests_{uuid.uuid4().hex}", keys=keys)


def op7_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def op8_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_maximum_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one turn in five dropped, emptied, cut, repeated or given to the user."""
    space, code = F.lit(" "), F.col("_code")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    kept = rows.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("_code")).where("_code != 0")
    return kept.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies).drop("_copy")


def op12_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    reports = written(conversations.judge(rows), "reports")
    shas = conversations.digests(conversations.repaired(rows, reports)).withColumnRenamed("conv_id", "_hashed")
    every = given.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    found = every.join(reports, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").join(shas, F.col("_conv").eqNullSafe(F.col("_hashed")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *conversations.COUNTS, "cost")]
    return found.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_pii_crf, op2_sampled_splitters, op3_link_graph, op4_cotraining, op5_pair_merging, op6_cutting_stock, op7_digest_index, op8_ngram_product, op9_edit_matching, op10_maximum_entropy, op11_token_files, op12_matrix_scan, op13_norm_buckets)}

ORACLE_SQL = {
    "op7_digest_index": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
        SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, text_sha256
        FROM n JOIN g USING (text_sha256)
    """,
}
