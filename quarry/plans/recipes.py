"""The part of the catalogue about recipes: previews, validators, retries, votes, link tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import recipes, urls
from quarry.operators import retries
from quarry.plans.catalogue import query

_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_IMAGE = """coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]*name="og:image"[^>]*content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?i)<img[^>]*\\ssrc="([^"]*)"', 1), ''))"""
COURSE = ["course_id", "course_name", "course_description"]


@query(f"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]*name="og:title"[^>]*content="([^"]*)"', 1), '')) AS title,
    nullif(regexp_extract(html, '(?i)<meta[^>]*name="og:description"[^>]*content="([^"]*)"', 1), '') AS description,
    CASE WHEN {_IMAGE} LIKE '/%' THEN {_ORIGIN} || {_IMAGE} ELSE {_IMAGE} END AS thumbnail FROM pages""")
def b04_preview(t):
    shown = recipes.preview(F.col("url"), F.col("html"))
    return t.pages.select("page_id", *(c.alias(k) for k, c in shown.items()))


@query("""SELECT user_id, CASE WHEN first IS NULL THEN latest ELSE best END AS event_id, coalesce(first, last) AS tries, first IS NOT NULL AS passed FROM
    (SELECT user_id, min(k) FILTER (here AND good) AS first, max(k) AS last, arg_min(event_id, k) FILTER (here AND good) AS best, arg_max(event_id, k) FILTER (here) AS latest FROM
    (SELECT *, k = 1 OR value > 20 AS here, event_type = 'view' AS good FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)) WHERE k <= 4 GROUP BY 1)""")
def b22_retries(t):
    """A call's answer is kept once it passes; at most three more are asked for."""
    return retries.settled(t.events.select("user_id", "event_id", "value", "event_type"), "user_id", "event_id", "event_id", F.col("value") > 20, F.col("event_type") == "view")


@query(f"SELECT page_id, md5('Find every course on the page ' || url || chr(10) || 'Fields: {', '.join(COURSE)}' || chr(10) || 'Page:' || chr(10) || html) AS digest FROM pages")
def b28_prompts(t):
    return t.pages.select("page_id", F.md5(recipes.prompt("course", COURSE, F.col("url"), F.col("html"))).alias("digest"))


@query("""SELECT page_id, len(list_filter(l, lambda x: NOT regexp_matches(x, '^/[a-zA-Z,.]+$'))) = 0 AS found FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def b29_regexp_finds_all(t):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", recipes.finds_all(links, "^/[a-zA-Z,.]+$").alias("found"))


@query(r"""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN kind = 'other' THEN 'unknown pagination type' WHEN page_id % 7 = 0 THEN 'pattern is not a URL'
    WHEN kind != 'page_num' THEN 'pattern has no placeholder' WHEN page_id % 5 = 0 AND path != '' THEN 'path not found in the page' WHEN page_id % 13 < 2 THEN 'bad start page' END AS error
    FROM (SELECT page_id, ['page_num', 'offset', 'other'][page_id % 3 + 1] AS kind, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def b30_pagination_checks(t):
    page = F.col("page_id")
    bare = F.regexp_extract("url", "^([^?#]*)", 1)
    pattern = F.concat(F.when(page % 7 == 0, "/list").otherwise(bare), F.lit("?p={page_num}"))
    kind = F.element_at(F.array(*map(F.lit, ("page_num", "offset", "other"))), (page % 3 + 1).cast("int"))
    content = F.when(page % 5 == 0, F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit(" "))).otherwise(F.concat(F.lit("see "), F.col("url"), F.lit("/")))
    start = F.when(page % 13 == 0, -1.0).when(page % 13 == 1, 1.5).when(page % 13 > 5, 0.0)
    return t.pages.select("page_id", recipes.pagination_error(page % 11 != 0, kind, pattern, content, start).alias("error"))


@query("""SELECT page_id, links, CASE WHEN links > 2 THEN 'too many links' END AS error FROM (SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<(?:a|button)[^>]*href="([^"]*)"', 1))) AS links FROM pages)""")
def b38_clickables(t):
    """What a page offers to follow, once each; more than the limit is an error of the page."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('(?i)<(?:a|button)[^>]*href="([^"]*)"'), F.lit(1)))
    return t.pages.select("page_id", F.size(links).cast("long").alias("links")).withColumn("error", F.when(F.col("links") > 2, "too many links"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 4 = 0 THEN 'empty selector' END WHEN 1 THEN CASE WHEN p_size <= 10 OR p_size > 40 THEN 'bad seconds' END ELSE 'unknown step' END AS error FROM part""")
def b39_setup_steps(t):
    kind = F.element_at(F.array(*map(F.lit, ("click", "wait", "hover"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", recipes.setup_error(kind, F.when(F.col("p_size") % 4 == 0, "  ").otherwise("#next"), (F.col("p_size") - 10) * F.lit(20.0)).alias("error"))


@query("SELECT o_orderkey, array_to_string(list_transform(string_split(o_orderpriority, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown FROM orders")
def b52_display(t):
    return t.orders.select("o_orderkey", recipes.title_case(F.col("o_orderpriority")).alias("title"), recipes.concise_date(F.col("o_orderdate")).alias("shown"))


@query(f"""SELECT page_id, {_ORIGIN} || l AS link FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS l FROM pages) WHERE regexp_matches(l, '^/[a-m]')""")
def b60_link_test(t):
    """The links of a page that a recipe's expression finds, as absolute URLs."""
    links = t.pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))).alias("l"))
    return links.where(F.col("l").rlike("^/[a-m]")).select("page_id", urls.resolve(F.col("url"), F.col("l")).alias("link"))


@query("""WITH c AS (SELECT *, CASE event_type WHEN 'view' THEN 'DETAIL' WHEN 'click' THEN 'CATEGORY_LINKS' END AS page_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    v AS (SELECT user_id, page_type, count(*) AS n, max(k) AS reached FROM c WHERE k <= 5 AND page_type IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, reached) AS r FROM v)
    SELECT u.user_id, coalesce(page_type, 'DETAIL_LINKS') AS page_type FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w ON w.user_id IS NOT DISTINCT FROM u.user_id AND r = 1""")
def c16_page_type_vote(t):
    """Five detections vote; none that knows: the default."""
    kind = F.when(F.col("event_type") == "view", "DETAIL").when(F.col("event_type") == "click", "CATEGORY_LINKS")
    return retries.voted(t.events.select("user_id", "event_id", kind.alias("page_type")), "user_id", "event_id", "page_type", 5, "DETAIL_LINKS")
