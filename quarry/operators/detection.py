"""How a site is to be crawled, found out from recorded answers about its pages: votes, agreement and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Calls that vote, by task; links that are sampled on a page; how deep categories may lie in categories.
VOTES = {"type": 10, "pagination": 10, "regexp": 3}
SAMPLE, DEEPEST = 5, 3
_PAGE = ["site", "depth", "level", "page"]


def best_of(calls: DataFrame) -> DataFrame:
    """calls: site, depth, level, page, task, try, answer. A column for each task: the most frequent answer of its first
    calls, of several the one that got there first; null without an answer. Tries are numbered from 1 within a task."""
    allowed = F.lit(False)
    for task, n in VOTES.items():
        allowed = allowed | (F.col("task") == task) & (F.col("try") <= n)
    counted = calls.where(allowed & F.col("answer").isNotNull()).groupBy(*_PAGE, "task", "answer").agg(F.count(F.lit(1)).alias("n"), F.max("try").alias("reached"))
    best = [F.max_by(F.when(F.col("task") == t, F.col("answer")), F.when(F.col("task") == t, F.struct("n", -F.col("reached")))).alias(t) for t in VOTES]
    return counted.groupBy(*_PAGE).agg(*best)


def configured(calls: DataFrame, providers: DataFrame) -> DataFrame:
    """calls as for ``best_of``; providers: site, provider, for sites with an interface of their own. site, provider,
    configuration (``type|regexp|pagination`` of each level, in order), error: one of the three for each site.

    ``depth`` counts the recursion, ``level`` the pages below where it stands: 0 that page, 1 the links sampled from it, 2
    the links sampled from the first of these. A page of details ends it. Sampled pages must be of one type, and what
    hangs below a page of detail links must be details. Each level takes over the pagination of the page above all.
    Categories below categories begin anew from a page of level 2, at most DEEPEST deep."""
    best = best_of(calls).where((F.col("level") == 0) | F.col("page").between(1, SAMPLE))
    first = F.struct("page")
    at = best.groupBy("site", "depth", "level").agg(F.min("type").alias("type"), F.max("type").alias("other"), F.min_by("regexp", first).alias("regexp"), F.min_by("pagination", first).alias("pagination"))
    level = lambda k, c: F.max(F.when(F.col("level") == k, F.col(c)))
    columns = [level(k, c).alias(f"{c}{k}") for k in range(3) for c in ("type", "other", "regexp", "pagination")]
    step = at.groupBy("site", "depth").agg(*columns)
    ends = F.col("type0") == "DETAIL"
    short = F.col("type1") == "DETAIL"

    def wrong(k: int, where: str):
        below = (F.col(f"type{k - 1}") == "DETAIL_LINKS") & (F.col(f"type{k}") != "DETAIL")
        return F.when(F.col(f"type{k}").isNull(), f"{where}: no results").when(F.col(f"type{k}") != F.col(f"other{k}"), f"{where}: mixed results").when(below, F.concat(F.lit(f"{where}: expected details, found "), F.col(f"type{k}")))

    error = F.when(F.col("type0").isNull(), "no page type").when(~ends, F.coalesce(wrong(1, "links"), F.when(~short, wrong(2, "links of links"))))
    again = ~ends & (F.col("type1") == "CATEGORY_LINKS")
    error = F.coalesce(error, F.when(F.coalesce(again, F.lit(False)) & (F.col("depth") == DEEPEST), "categories too deep"))

    def shown(k: int):
        regexp = F.when(F.col(f"type{k}") != "DETAIL", F.col(f"regexp{k}"))
        return F.concat_ws("|", F.col(f"type{k}"), F.coalesce(regexp, F.lit("")), F.coalesce("pagination0", F.lit("")))

    levels = F.concat_ws(" > ", shown(0), F.when(~ends, shown(1)), F.when(~ends & ~short, shown(2)))
    step = step.select("site", "depth", error.alias("error"), levels.alias("levels"), F.coalesce(again & error.isNull(), F.lit(False)).alias("again"))
    # Steps of a site: DEEPEST at most. One that an earlier step doesn't lead to isn't taken; one that it leads to and
    # nobody has looked at has no page type.
    earlier = W.partitionBy("site").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    taken = step.withColumn("taken", F.coalesce(F.bool_and("again").over(earlier), F.lit(True)) & (F.col("depth") == F.row_number().over(W.partitionBy("site").orderBy("depth"))))
    last = F.max_by("again", "depth")
    whole = taken.where("taken").groupBy("site").agg(F.array_join(F.sort_array(F.collect_list(F.struct("depth", "levels")))["levels"], " >> ").alias("configuration"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("depth"))).alias("error"), last.alias("_open"))
    sites = calls.select("site").distinct().join(providers, "site", "full")
    found = sites.join(whole, "site", "left")
    error = F.coalesce(F.col("error"), F.when(F.coalesce("_open", F.lit(True)), "no page type"))
    given = F.col("provider").isNotNull()
    return found.select("site", "provider", F.when(~given & error.isNull(), F.col("configuration")).alias("configuration"), F.when(~given, error).alias("error"))
