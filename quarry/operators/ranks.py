"""Ranks without one big task: neither a whole table nor a hot key is ever sorted in one place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later step reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(folder), True)


def first_rows(df: DataFrame, order: list[Column], part: float) -> DataFrame:
    """The first ceil(rows * part) rows of an order. The table is sorted in ranges and written once; of the ranges whole
    ones are kept, and only the one in which the cut falls is numbered."""
    ranges = written(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "sorted")
    # One row for each range.
    sizes = sorted(ranges.groupBy("_range").count().collect())
    left = max(0, -int(-sum(n for _, n in sizes) * part // 1))
    for at, n in sizes:
        if n > left:
            inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
            last = ranges.where(F.col("_range") == at).withColumn("_place", inside).where(F.col("_place") <= left).drop("_place")
            return ranges.where(F.col("_range") < at).unionByName(last).drop("_range")
        left -= n
    return ranges.drop("_range")


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: 1, 2, 3 ... over the whole table, which is sorted in ranges and written once; a row's number is its
    place in its range after the sizes of the ranges before."""
    ranges = written(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "sorted")
    # One row for each range.
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    starts = [(at, sum(n for _, n in sizes[:i])) for i, (at, _) in enumerate(sizes)]
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _before long"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_place", inside).join(before, "_range").withColumn(out, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def placed(df: DataFrame, key: str, order: list[Column | str], out: str, ranges: int = 64) -> DataFrame:
    """Adds ``out``: 1, 2, 3 ... within each key by ``order``. Rows are dealt to ranges of the order and written once;
    keys are numbered range by range, so that a key which holds a third of all rows is many tasks' work. Null keys are
    no keys: null."""
    dealt = written(df.where(F.col(key).isNotNull()).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "placed")
    sizes = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(key, "_range", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(key, "_range").orderBy(*order))
    ranked = dealt.withColumn("_place", inside).join(before, [key, "_range"]).withColumn(out, (F.col("_place") + F.col("_before")).cast("long"))
    none = df.where(F.col(key).isNull()).withColumn(out, F.lit(None).cast("long"))
    return ranked.select(*df.columns, out).unionByName(none)
