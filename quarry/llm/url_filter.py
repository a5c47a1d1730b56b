"""Operator 3: URL filter by trust and distrust over the host graph, in DataFrame operations only.

Rules judge first (the longest that fits). Hosts of allowed pages seed a personalised PageRank along links, hosts
of blocked pages one against them; a host whose distrust exceeds its trust is blocked, else allowed. Edges are
links to other hosts in the pages' HTML and, as many sites link by relative paths only, the tie between a host
and its parent domain where both occur as hosts or parents (``family``). A url that is null or has no ``://`` has
empty host and path and no edges, and is allowed. Null html: no links. Repeated rows count as pages of their own. Empty
table: no rows. Very long pages: their links are found by one pattern in the JVM. Columns other than page_id, url and
html are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, written

#: Fixed values of the contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LINK = "(?i)href\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s<>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, change: float = 1e-3, most: int = 240, damping: float = 0.85, every: int = 6) -> DataFrame:
    """Personalised PageRank of several kinds at once. edges: kind, src, dst, weight; seeds: kind, host, seed (summing
    to 1 by kind). Returns kind, host, score, summing to 1 by kind.

    Mass at hosts without links goes back to the seeds. Such ranks are those of the plain series of ever longer walks
    from the seeds, scaled to sum to 1, so that no round needs the mass that got lost. Each round adds the walks that
    are one link longer; their mass falls by ``damping`` at least from round to round, so the rounds that it takes until
    ``every`` of them add less than ``change`` of the mass of each kind have a bound whatever the graph's size."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    steps = written(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out") * damping).alias("share")), "host-steps")
    start = seeds.select("kind", "host", F.col("seed").alias("score"))
    ranks, was = start, {}
    for _ in range(0, most, every):
        for _ in range(every):
            moved = ranks.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        ranks = written(ranks, "host-ranks")
        # A row for each kind: two at most.
        mass = {r["kind"]: r["mass"] for r in ranks.groupBy("kind").agg(F.sum("score").alias("mass")).collect()}
        if all(m - was.get(k, 0.0) < change * m for k, m in mass.items()):
            scale = F.broadcast(ranks.groupBy("kind").agg(F.sum("score").alias("mass")))
            return ranks.join(scale, "kind").select("kind", "host", (F.col("score") / F.col("mass")).alias("score"))
        was = mass
    raise RuntimeError(f"propagate: ranks still change by more than {change} after {most} rounds")


def judge(pages: DataFrame, rules=RULES, change: float = 1e-3, threshold: float = 1.0, family: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; one row per row of ``pages``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower)).alias("links"))
    slim = written(judged, "pages-judged")
    counts = slim.where((F.col("host") != "") & F.col("ruled").isNotNull()).groupBy("host", "ruled").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("ruled").agg(F.sum("n").alias("all"))
    # One row for each verdict: two at most.
    seeds = written(counts.join(F.broadcast(totals), "ruled").select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host", (F.col("n") / F.col("all")).alias("seed")), "host-seeds")
    links = slim.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if family:
        hosts = slim.select("host").where("host != ''").distinct()
        parent = F.regexp_replace("host", "^[^.]*\\.", "")
        ties = hosts.where(F.size(F.split("host", "\\.")) > 2).select(F.col("host").alias("src"), parent.alias("dst"))
        ties = ties.unionByName(ties.where(F.size(F.split("dst", "\\.")) > 2).select(F.col("dst").alias("src"), F.regexp_replace("dst", "^[^.]*\\.", "").alias("dst"))).distinct()
        both = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
        links = links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = written(links, "host-edges")
    ways = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight").withColumn("kind", F.lit("distrust")))
    scores = propagate(ways, seeds, change)
    hosts = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    hosts = hosts.withColumn("method", F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow"))
    # A host may hold a third of all pages: AQE splits its partition of this join, and the host side is one row each.
    out = slim.drop("links").join(hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
