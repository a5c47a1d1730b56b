"""More of the catalogue: work lists, writes, URL algebra and answers of servers."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarry.functions import text, urls
from quarry.operators import ranks, relational as rel, writes
from quarry.plans.catalogue import HOST, query


@query("SELECT o_custkey, count(*) AS pages, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1")
def a15_step_page_count(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey")
def a17_error_pages(t):
    """All of them, latest first."""
    return t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def a17_all_error_pages(t):
    """Every error page of every extraction (o_custkey), with its place in the extraction's list."""
    errors = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate", "o_custkey")
    return ranks.placed(errors, "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], "place")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'fetch' ELSE 'extract' END AS work FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_orderpriority LIKE '1%'")
def a19_work_list(t):
    detail = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1")
    return t.orders.where((F.col("o_orderstatus") == "O") | detail).select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "fetch").otherwise("extract").alias("work"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def a24_first_actor(t):
    return t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def a29_without_jobs(t):
    return rel.by_sort(t.orders.where("o_orderstatus = 'O'"), t.lineitem.where("l_linenumber = 1"), "o_orderkey", "l_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_custkey, o_orderkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY o_orderkey DESC LIMIT 20")
def a41_datasets_page(t):
    """The first page of 20; what its rows hold is counted for them alone."""
    first = rel.page(t.orders.select("o_custkey", "o_orderkey"), [F.desc("o_orderkey")])
    return rel.with_count(first, t.lineitem, "o_orderkey", "l_orderkey", "items").select("o_custkey", "o_orderkey", "items")


@query("""SELECT o_custkey, o_orderkey, total, place, count(l_orderkey) AS items FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS total,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE place <= 20 GROUP BY ALL""")
def a41_datasets_pages(t):
    """The first page of 20 of every parent, each row with the parent's total. Totals are counted apart, so that each
    task keeps 20 rows of a parent before the shuffle."""
    total = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    paged = t.orders.select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 20").join(total, "o_custkey")
    return rel.with_count(paged, t.lineitem, "o_orderkey", "l_orderkey", "items").select("o_custkey", "o_orderkey", "total", "place", "items")


@query("SELECT count(*) AS n FROM customer WHERE c_name ILIKE '%9%' OR len(list_filter(string_split(c_name, '#'), lambda x: x ILIKE '%77')) > 0")
def a42_array_search_count(t):
    return t.customer.where(F.col("c_name").ilike("%9%") | F.exists(F.split("c_name", "#"), lambda x: x.ilike("%77"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AS may_go FROM nation")
def a46_delete_guard(t):
    n = rel.with_count(t.nation, t.supplier, "n_nationkey", "s_nationkey", "n")
    return n.select("n_nationkey", (F.col("n") == 0).alias("may_go"))


@query("""SELECT p.p_partkey AS id, CASE WHEN q.p_partkey IS NULL THEN 0 ELSE q.p_partkey END AS parent, count(k.p_partkey) AS children
    FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey // 2 LEFT JOIN part k ON k.p_partkey // 2 = p.p_partkey GROUP BY 1, 2""")
def a47_step_tree(t):
    """A step whose parent is missing hangs below the root (0)."""
    p = t.part.select(F.col("p_partkey").alias("id"))
    up = p.select(F.col("id").alias("parent"))
    tree = p.withColumn("up", F.expr("id div 2")).join(up, F.col("up") == F.col("parent"), "left").select("id", F.coalesce("parent", F.lit(0)).cast("long").alias("parent"), "up")
    return rel.with_count(tree, tree.select(F.col("up").alias("c")), "id", "c", "children").select("id", "parent", "children")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def a64_reset_guarded(t):
    return writes.update(t.orders, (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0), o_orderstatus=F.lit("O")).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_custkey = 5 AS is_default FROM customer")
def a65_set_default(t):
    return writes.set_single(t.customer.withColumn("is_default", F.col("c_custkey") % 2 == 0), "is_default", F.col("c_custkey") == 5).select("c_custkey", "is_default")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'new' FROM nation WHERE n_nationkey % 5 = 0")
def a67_upsert(t):
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    ids = old.where("n_nationkey % 5 = 0").select("n_nationkey")
    new = ids.unionByName(ids.select((F.col("n_nationkey") + 100).alias("n_nationkey"))).withColumn("n_name", F.lit("new"))
    return writes.upsert(old, new, "n_nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def a68_cascade(t):
    return writes.cascade(t.lineitem, t.orders.where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (value > 50), 'ALWAYS') AS preference FROM events GROUP BY 1")
def a69_merge_preferences(t):
    """The latest patch over the default."""
    patch = F.max_by(F.when(F.col("value") > 50, F.col("event_type")), F.when(F.col("value") > 50, F.col("event_id")))
    return t.events.groupBy("user_id").agg(F.coalesce(patch, F.lit("ALWAYS")).alias("preference"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'DETAIL' WHEN 'F' THEN 'DETAIL_LINKS' ELSE 'CATEGORY_LINKS' END AS page_type FROM orders")
def a71_recode(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "O", "DETAIL").when(s == "F", "DETAIL_LINKS").otherwise("CATEGORY_LINKS").alias("page_type"))


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query(f"SELECT page_id, {_ORIGIN} || '/a/c' AS up, {_ORIGIN} || '/x?y=1' AS rooted, 'https://o.org/z' AS whole, 'https://o.org/q' AS same_scheme FROM (SELECT page_id, regexp_replace(url, '^http:', 'https:') AS url FROM pages)")
def b08_resolve_url(t):
    base = F.concat(urls.origin(F.regexp_replace("url", "^http:", "https:")), F.lit("/a/b/d.html?k=1#f"))
    links = {"up": "../c", "rooted": "/x?y=1", "whole": "https://o.org/z", "same_scheme": "//o.org/q"}
    return t.pages.select("page_id", *(urls.resolve(base, F.lit(v)).alias(k) for k, v in links.items()))


@query(f"SELECT page_id FROM pages WHERE {HOST} = 'example.com' OR {HOST} LIKE 'www.%'")
def b11_same_host(t):
    return t.pages.where((urls.host(F.col("url")) == "example.com") | urls.host(F.col("url")).startswith("www.")).select("page_id")


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^A-z0-9.\-\s;\\,]', '', 'g')) AS digest FROM documents")
def b19_strip(t):
    return t.documents.select("doc_id", F.md5(text.strip_non_alphanumeric(F.col("text"))).alias("digest"))


@query("SELECT doc_id, contains(text, lang) AND contains(text, source) OR source IS NULL AND contains(text, lang) AS passed FROM documents WHERE lang IS NOT NULL")
def b21_passes(t):
    flags = {n: (F.col(n), F.col("text").contains(F.col(n))) for n in ("lang", "source")}
    return t.documents.where("lang is not null").select("doc_id", text.passes(flags, ["lang", "source"]).alias("passed"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN true WHEN event_type = 'error' THEN false END AS flag, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def b31_arguments(t):
    word = F.when(F.col("event_type").isin("view", "click"), "Yes").when(F.col("event_type") == "error", "null").otherwise("maybe")
    return t.events.select("event_id", urls.as_bool(word).alias("flag"), urls.as_count(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT p_partkey, 380 + p_size IN (402, 403, 407) OR p_partkey % 7 = 0 AS proxy, CASE 380 + p_size WHEN 400 THEN 'Bad Request' WHEN 401 THEN 'Unauthorized' WHEN 403 THEN 'Forbidden' WHEN 404 THEN 'Not Found' WHEN 407 THEN 'Proxy related error' ELSE 'HTTP ' || (380 + p_size) END AS said FROM part")
def b35_server_answers(t):
    status, message = F.col("p_size") + 380, F.when(F.col("p_partkey") % 7 == 0, "at net::ERR_CONNECTION_REFUSED x")
    return t.part.select("p_partkey", urls.is_proxy_error(status, message).alias("proxy"), urls.http_message(status).alias("said"))


@query("SELECT p_partkey, p_size % 2 = 1 AS fits FROM part")
def b50_url_pattern(t):
    url = F.concat(F.lit("https://x.edu/c?kind="), (F.col("p_size") % 2).cast("string"), F.lit("&page="), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", urls.matches_pattern(url, F.lit("https://x.edu/c?kind=1&page={page_num}"), ["kind", "page"]).alias("fits"))


@query("SELECT c_custkey, c_name AS name, true AS hidden FROM customer")
def b51_sealed_settings(t):
    key = F.lit("0123456789abcdef0123456789abcdef")
    kept = t.customer.select("c_custkey", "c_name", urls.sealed(F.col("c_name"), key).alias("sealed"))
    return kept.select("c_custkey", urls.opened(F.col("sealed"), key).alias("name"), (~F.col("sealed").contains(F.col("c_name"))).alias("hidden"))


@query("SELECT c_custkey, 'u' || c_custkey || ':******@h:80' AS shown FROM customer")
def b53_masked_proxy(t):
    return t.customer.select("c_custkey", text.mask_proxy(F.concat(F.lit("http://u"), F.col("c_custkey").cast("string"), F.lit(":secret@h:80"))).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'COMPLETE' ELSE 'IN_PROGRESS' END AS status, o_custkey % 10 = 0 AS audited FROM orders")
def c13_cancel(t):
    """Cancelling sets the status and leaves a row in the audit log, whatever the status was."""
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("IN_PROGRESS")
    asked = F.col("o_custkey") % 10 == 0
    return writes.update(t.orders.withColumn("status", status), asked, status=F.lit("CANCELLED")).select("o_orderkey", "status", asked.alias("audited"))
