"""Nested reads in one plan: children are gathered by their parent before the join, never looked up parent by parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_list(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Each parent with its children's values as an array in the given order (ascending; negate numbers to descend);
    an empty array for none. A parent's list is as long as it has children: lists are for bounded children."""
    places = [c.alias(f"k{i}") for i, c in enumerate(order)]
    listed = children.groupBy(F.col(child_key).alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct(*places, value.alias("v")))), lambda x: x["v"]).alias(out))
    return parents.join(listed, key, "left").withColumn(out, F.coalesce(out, F.array().cast(listed.schema[out].dataType)))


def first_or_default(df: DataFrame, key: str, is_default: Column, order: Column, value: Column, out: str) -> DataFrame:
    """key, out: the value of the default row, of several the latest by ``order``; null where none is the default."""
    return df.groupBy(key).agg(F.max_by(F.when(is_default, value), F.when(is_default, order)).alias(out))


def deep_merge(*layers: Column) -> Column:
    """Of maps, later ones win key by key; a null map changes nothing, a null value is a value."""

    def without(m: Column, keys: Column) -> Column:
        return F.map_filter(m, lambda k, v: ~F.map_contains_key(keys, k))

    out = layers[0]
    for layer in layers[1:]:
        more = F.coalesce(layer, F.map_filter(layers[0], lambda k, v: F.lit(False)))
        out = F.map_concat(without(out, more), more)
    return out
