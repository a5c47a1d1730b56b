"""Ancestors in a table of parents, by pointer doubling: as many joins as the depth has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators.ranks import forget, written


def ancestors(nodes: DataFrame) -> DataFrame:
    """nodes: id, parent. id, depth (nodes on the way up, itself included), root; both null, and ``cyclic``, where the way
    never ends. A parent that the table lacks, or null, ends it. Ids are keys.

    Every node points to an ancestor and knows how far up it is; in each round it takes over the pointer of the node that
    it points to, so distances double. Nodes that have arrived point nowhere and are not joined again. After as many
    rounds as the number of nodes has digits, whoever still points somewhere does so around a cycle."""
    rows = nodes.select("id", "parent").where(F.col("id").isNotNull())
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    # A parent of very many children is one row of ``known``, so only its children's side is large.
    state = rows.withColumnRenamed("parent", "up").join(known, "up", "left").select("id", F.when(F.col("_known"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("steps"))
    state = written(state.withColumn("top", F.when(F.col("up").isNull(), F.col("id")).otherwise(F.col("up"))), "pointers")
    for _ in range(state.count().bit_length() + 1):
        if not state.where("up is not null").limit(1).count():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("top").alias("_top"))
        moved = state.where("up is not null").join(above, "up").select("id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_top").alias("top"))
        new = written(state.where("up is null").unionByName(moved), "pointers")
        forget(state)
        state = new
    ended = F.col("up").isNull()
    return state.select("id", F.when(ended, F.col("steps")).alias("depth"), F.when(ended, F.col("top")).alias("root"), (~ended).alias("cyclic"))
