"""A session's folder for tables between two steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, of the session's spark.checkpoint.dir; a temporary one only on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")
