"""Writes as DataFrames: what a table holds after them. The caller writes the result beside the old one and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators import ranks


def update(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets the values where the condition holds (null: it does not)."""
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def append(old: DataFrame, new: DataFrame, key: str, **defaults: Column) -> tuple[DataFrame, DataFrame]:
    """(table, added): ``new`` rows with defaults for what they leave out and keys after the greatest; keys follow the
    order of the rows' values, so that a rerun gives the same. However many rows are new, no task sorts them all."""
    last = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    columns = [c for c in old.columns if c != key]
    full = new.select(*(F.col(c) if c in new.columns else defaults.get(c, F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in columns))
    numbered = ranks.numbered(full, columns, "_number")
    added = numbered.withColumn(key, (F.lit(last) + F.col("_number")).cast(old.schema[key].dataType)).select(old.columns)
    return old.unionByName(added), added


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old ones with their key; of new rows that share a key one stays, the greatest."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("x")).select(key, "x.*")
    return old.join(one, key, "left_anti").unionByName(one)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is there already are dropped; of new rows that share a key one stays, the least."""
    rest = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("x")).select(key, "x.*")
    return old.unionByName(one.join(old, key, "left_anti"))


def cascade(children: DataFrame, gone: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The children whose parent stays."""
    return children.join(gone.select(F.col(parent_key).alias(key)), key, "left_anti")


def set_single(df: DataFrame, flag: str, chosen: Column) -> DataFrame:
    """The flag on the chosen row and on no other, in the whole table."""
    return df.withColumn(flag, F.coalesce(chosen, F.lit(False)))


def set_if_none(df: DataFrame, flag: str, group: str, chosen: Column) -> DataFrame:
    """The flag on the chosen row of each group that has none yet; others stay as they are."""
    has = df.groupBy(group).agg(F.max(F.coalesce(flag, F.lit(False))).alias("_has"))
    marked = df.join(has, df[group].eqNullSafe(has[group])).drop(has[group])
    return marked.withColumn(flag, F.when(F.col("_has"), F.coalesce(flag, F.lit(False))).otherwise(F.coalesce(chosen, F.lit(False)))).drop("_has")


def checked_steps(pages: DataFrame, step: str, place: str, url: str) -> DataFrame:
    """All or nothing by step: the step, its pages (0 when it is refused), and why: its first blank URL's place, or a URL
    that it has twice."""
    blank = F.col(url).isNull() | (F.trim(url) == "")
    by = pages.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(blank, F.col(place))).alias("at"), F.count(F.when(~blank, F.col(url))).alias("urls"), F.count_distinct(F.when(~blank, F.col(url))).alias("kinds"))
    error = F.when(F.col("at").isNotNull(), F.concat(F.lit("blank URL at "), F.col("at").cast("string"))).when(F.col("urls") > F.col("kinds"), "a URL occurs twice")
    return by.select(step, F.when(error.isNull(), F.col("n")).otherwise(F.lit(0)).alias("pages"), error.alias("error"))
