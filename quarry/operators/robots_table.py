"""Robots rules of many hosts: parsed once for each host, and met by the host's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions import extraction as ex, robots, urls


def rules_by_host(files: DataFrame, agent: str = "*") -> DataFrame:
    """files: host, body. host, agent, allow, disallow, delay, error: the rule that holds for ``agent``. A file with a bad
    pattern is its own host's error. Hosts are keys."""
    return files.select("host", robots.combined_for(agent)(F.col("body")).alias("r")).select("host", "r.*")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages: url and others. Adds host, allowed (null where the host's rules are in error), interval_ms and error. A
    host without rules allows all. A page is held against its host's two expressions, however many rules there are; a
    host with very many pages is split like any skewed key of a join."""
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    found = pages.withColumn("host", urls.host(F.col("url"))).join(rules.select("host", "allow", "disallow", "delay", "error", F.lit(True).alias("ruled")), "host", "left")
    free = robots.permitted()(F.when(path == "", "/").otherwise(path), F.col("allow"), F.col("disallow"))
    out = found.withColumn("allowed", F.when(F.col("error").isNull(), free))
    wait = ex.interval_ms(F.coalesce("ruled", F.lit(False)) & F.col("error").isNull(), F.coalesce("allowed", F.lit(False)), F.col("delay"))
    return out.withColumn("interval_ms", wait).drop("allow", "disallow", "delay", "ruled")
