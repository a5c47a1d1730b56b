"""Relational operators over extraction tables, as functions of DataFrames."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators import ranks


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The conditions that are given, all of them."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def with_count(parents: DataFrame, children: DataFrame, key: str, child_key: str, out: str) -> DataFrame:
    """Each parent with how many children it has: children are counted before the join."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(out))
    return parents.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


#: Rows that a task of ``by_sort`` has, about, of the longer side.
TASK_ROWS = 1 << 19


def by_sort(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """The join of two tables that both grow. Neither goes whole to every task, however narrow it is, and there are as
    many tasks as rows ask for, so that each sorts as many on larger tables. Left rows without a key should be apart."""
    n = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(max(left.count(), right.count()) / TASK_ROWS))
    return left.repartition(n, left_key).join(right.repartition(n, right_key).hint("merge"), F.col(left_key) == F.col(right_key), how)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the greatest by the order. Combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def sample_percent(df: DataFrame, order: list[Column], percent: float) -> DataFrame:
    """The first ceil(total * percent / 100) rows of an order."""
    return ranks.first_rows(df, order, percent / 100)


def suffixed(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """The k-th row of a key gets ``key-k`` from the second on; null and blank keys stay as they are and aren't counted."""
    text = F.col(key).cast("string")
    counted = ranks.placed(df.withColumn("_key", F.when(F.trim(text) != "", text)), "_key", order, "_k")
    return counted.withColumn(out, F.when(F.col("_k") > 1, F.concat_ws("-", text, F.col("_k").cast("string"))).otherwise(text)).drop("_key", "_k")
