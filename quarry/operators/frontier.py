"""A crawl whose visited URLs are a table: levels are added to it and looked up in it, whatever made them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators.ranks import written

VISITED = "digest long, url string, level int"


class Frontier:
    """Visited URLs, bucketed by digest, with a partition for each level. ``add`` may be run again for a level: it
    replaces that level and is decided by the earlier ones, so a lost driver goes on where it was."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        """``name``: a table in the session's warehouse, which all executors must share; it stays until ``drop``.
        ``buckets``: of a new table; as many as the session's shuffles have partitions unless given."""
        self.spark, self.name = spark, name or f"visited_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([], VISITED).write.partitionBy("level").bucketBy(n, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)

    def visited(self) -> DataFrame:
        return self.spark.table(self.name).select("digest", "url", "level")

    def add(self, urls: DataFrame, level: int) -> int:
        """Adds the URLs (url) that no earlier level has, and returns how many they are. The visited side is read in its
        buckets; only the new URLs are shuffled."""
        new = urls.where("url is not null").select(F.xxhash64("url").alias("digest"), "url").distinct()
        known = self.visited().where(F.col("level") < level).select("digest", "url")
        fresh = written(new.join(known.hint("merge"), ["digest", "url"], "left_anti"), "frontier")
        n = fresh.count()
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (level = {level}) SELECT digest, url FROM {{fresh}}", fresh=fresh)
        return n

    def level(self, level: int) -> DataFrame:
        return self.visited().where(F.col("level") == level).select("url")

    def crawl(self, seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
        """seeds: url; links: url, link. url, level of all that is reached within ``depth`` steps, from the table's last
        whole level on."""
        n, level = self.add(seeds, 0), 0
        while n and level < depth:
            found = self.level(level).join(links, "url").select(F.col("link").alias("url"))
            level += 1
            n = self.add(found, level)
        return self.visited().select("url", "level")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
