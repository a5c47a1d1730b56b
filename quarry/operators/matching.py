"""Order-free comparison of two multisets of rows in each group, field by field, each row used once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import text
from quarry.operators.ranks import forget, written

Matcher = Callable[[Column, Column], Column]


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def alike(least: float) -> Matcher:
    """Texts by edit similarity; two empty ones are alike."""
    return lambda a, b: F.coalesce(text.similarity(a, b) >= least, a.eqNullSafe(b))


def near(part: float) -> Matcher:
    """Numbers that differ by at most a part of the greater."""
    return lambda a, b: F.coalesce(F.abs(a - b) <= part * F.greatest(F.abs(a), F.abs(b)), a.eqNullSafe(b))


def cosine(least: float) -> Matcher:
    return lambda a, b: F.coalesce(text.cosine(a, b) >= least, a.eqNullSafe(b))


def matched(expected: DataFrame, actual: DataFrame, group: list[str], matchers: dict[str, Matcher], block: list[str] = ()) -> DataFrame:
    """Both sides: group, place, and a column for each matcher. group, expected, actual (first places of two classes of
    equal rows), n: so many rows of the one go with as many of the other. What is left over has a null on the other side.

    Greedy: classes of expected rows take, in order of their first places, the first classes of actual rows that all
    matchers accept and that have rows left. ``block`` names fields that must be equal, so that only rows of a block
    meet. A round settles every pair of classes that are each other's first choice among all that is left: for these no
    order could decide otherwise. Equal rows are one class with a number, so copies take no rounds of their own."""
    keys = [*group, *block]

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = list(dict.fromkeys([*matchers, *block]))
        return df.groupBy(*group, *fields).agg(F.min("place").alias(name), F.count(F.lit(1)).alias(f"{name}_left"))

    e, a = written(side(expected, "expected"), "expected"), written(side(actual, "actual"), "actual")
    other = a.select(*keys, "actual", *(F.col(f).alias(f"_{f}") for f in matchers if f not in block))
    on = [e[k].eqNullSafe(other[k]) for k in keys]
    fits = F.lit(True)
    for f, matcher in matchers.items():
        if f not in block:
            fits = fits & matcher(e[f], F.col(f"_{f}"))
    edges = written(e.join(other, on).where(fits).select(*(e[g] for g in group), "expected", "actual"), "edges")
    left = {"expected": e.select(*group, "expected", "expected_left"), "actual": a.select(*group, "actual", "actual_left")}
    out = None
    while edges.limit(1).count():
        first = edges.withColumn("_a", F.min("actual").over(W.partitionBy(*group, "expected"))).withColumn("_e", F.min("expected").over(W.partitionBy(*group, "actual")))
        sure = first.where("actual = _a and expected = _e").select(*group, "expected", "actual")
        for s in ("expected", "actual"):
            sure = _with(sure, left[s], [*group, s])
        sure = written(sure.withColumn("n", F.least("expected_left", "actual_left")), "sure")
        out = sure.select(*group, "expected", "actual", "n") if out is None else out.unionByName(sure.select(*group, "expected", "actual", "n"))
        gone = edges
        for s in ("expected", "actual"):
            taken = sure.select(*group, s, F.col("n").alias("_n"))
            left[s] = written(_with(left[s], taken, [*group, s], "left").withColumn(f"{s}_left", F.col(f"{s}_left") - F.coalesce("_n", F.lit(0))).drop("_n"), "left")
            edges = _with(edges, left[s].where(F.col(f"{s}_left") > 0).drop(f"{s}_left"), [*group, s], "left_semi")
        edges = written(edges, "edges")
        forget(gone)
    rest = [left[s].where(F.col(f"{s}_left") > 0).select(*group, F.col(s) if s == "expected" else F.lit(None).cast("long").alias("expected"), F.col(s) if s == "actual" else F.lit(None).cast("long").alias("actual"), F.col(f"{s}_left").alias("n")) for s in ("expected", "actual")]
    both = rest[0].unionByName(rest[1])
    return both if out is None else out.unionByName(both)


def _with(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    renamed = other.select(*(F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in other.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = df.join(renamed, on, how)
    return out if how == "left_semi" else out.drop(*(f"_k_{k}" for k in keys))
