"""Repeated calls over recorded answers: retries until one passes, and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_calls(calls: DataFrame, key: str, order: str, n: int, at: str = "try") -> DataFrame:
    """The first ``n`` calls of each key, numbered from 1; later ones are dropped before the shuffle."""
    return calls.withColumn(at, F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col(at) <= n)


def settled(calls: DataFrame, key: str, order: str, answer: str, returned: Column, passed: Column, retries: int = 3) -> DataFrame:
    """key, answer, tries, passed: the first call's answer, replaced by each retry's that returned one, until one
    passes or ``retries`` are spent. The first call counts as returned."""
    got = first_calls(calls, key, order, retries + 1)
    here = (F.col("try") == 1) | F.coalesce(returned, F.lit(False))
    good = here & F.coalesce(passed, F.lit(False))
    first, last = F.min(F.when(good, F.col("try"))), F.max("try")
    best = F.min_by(F.when(good, F.col(answer)), F.when(good, F.col("try")))
    latest = F.max_by(F.when(here, F.col(answer)), F.when(here, F.col("try")))
    return got.groupBy(key).agg(F.when(first.isNotNull(), best).otherwise(latest).alias(answer), F.coalesce(first, last).alias("tries"), first.isNotNull().alias("passed"))


def voted(calls: DataFrame, key: str, order: str, answer: str, votes: int, default: str) -> DataFrame:
    """key, answer: the most frequent answer of the first ``votes`` calls, of several the one that got there first."""
    got = first_calls(calls, key, order, votes)
    counted = got.groupBy(key, answer).agg(F.count(answer).alias("n"), F.max("try").alias("reached"))
    best = F.max_by(F.when(F.col("n") > 0, F.col(answer)), F.when(F.col("n") > 0, F.struct("n", -F.col("reached"))))
    return counted.groupBy(key).agg(F.coalesce(best, F.lit(default)).alias(answer))
