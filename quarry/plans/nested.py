"""Nested reads, scans, summaries and writes of the extraction tables.

The stand-ins: nation an institution, customer a catalogue, orders its recipes, extractions or pages, lineitem data
items, supplier a user, events model calls or logs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.operators import nested, ranks, relational as rel, writes
from quarry.plans.catalogue import DOMAIN, PRICES, query


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("""SELECT c_custkey, n_name, coalesce(r, '') AS recipes FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_custkey LIMIT 20 OFFSET 3)
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def a02_catalogues_page(t):
    """The page is cut before its recipes are gathered."""
    paged = rel.page(rel.where(t.customer, F.col("c_mktsegment") == "BUILDING", F.col("c_name").ilike("%1%")), [F.col("c_custkey")], 20, 3)
    mine = t.orders.join(F.broadcast(paged.select(F.col("c_custkey").alias("o_custkey"))), "o_custkey", "left_semi")
    full = nested.with_list(paged, mine, "c_custkey", "o_custkey", [F.col("o_orderkey")], F.col("o_orderkey"), "recipes")
    return full.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", _joined("recipes").alias("recipes"))


@query("""SELECT c_custkey, n_name, coalesce(r, '') AS recipes FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def a03_catalogue(t):
    """Recipes: the default ones (status F) first, then the latest."""
    order = [F.col("o_orderstatus") != "F", -F.unix_micros("o_orderdate"), F.col("o_orderkey")]
    full = nested.with_list(t.customer, t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "c_custkey", "o_custkey", order, F.col("o_orderkey"), "recipes")
    return full.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", _joined("recipes").alias("recipes"))


@query("SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id AND c_mktsegment = 'BUILDING' WHERE event_type = 'view'")
def a04_lookup(t):
    """Looked up by the unique pair of key and type: those asked for in events."""
    asked = t.events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return asked.join(t.customer, ["c_custkey", "c_mktsegment"]).select("event_id", "c_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def a06_dataset(t):
    """Four joins to one row each."""
    out = rel.by_sort(t.lineitem, t.orders, "l_orderkey", "o_orderkey", "left").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate", "c_name", "n_name", "r_name")


@query("""SELECT l_partkey, count(*) AS total, count(*) FILTER (o_orderkey IS NOT NULL) AS listed FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey END AS page FROM lineitem) LEFT JOIN orders ON page = o_orderkey GROUP BY 1""")
def a07_items_total(t):
    """The total of a dataset counts items without a page (line 1), which its list leaves out; A16 is the total. Orders are
    many, if narrow, so they aren't sent to every task; items without a page, which would meet in one, aren't joined."""
    items = t.lineitem.select("l_partkey", F.when(~F.col("l_linenumber").eqNullSafe(1), F.col("l_orderkey")).alias("page"))
    found = rel.by_sort(items.where("page IS NOT NULL"), t.orders.select("o_orderkey"), "page", "o_orderkey", "left")
    joined = found.select("l_partkey", F.col("o_orderkey").alias("there")).unionByName(items.where("page IS NULL").select("l_partkey", F.col("page").alias("there")))
    return joined.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total"), F.count("there").alias("listed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def a08_items_by_page(t):
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey) AS datasets FROM orders GROUP BY 1")
def a09_datasets_of_extraction(t):
    latest = nested.with_list(t.orders.select("o_custkey").distinct(), t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_custkey", "o_custkey", [-F.unix_micros("o_orderdate"), F.col("o_orderkey")], F.col("o_orderkey"), "datasets")
    return latest.select("o_custkey", _joined("datasets").alias("datasets"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def a10_extractions_page(t):
    listed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rel.page(listed, [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 40).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT o_orderkey, c_name, coalesce(s, '') AS steps FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber, l_partkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def a11_extraction_with_steps(t):
    full = nested.with_list(t.orders, t.lineitem, "o_orderkey", "l_orderkey", [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")], F.col("l_partkey"), "steps")
    return full.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", _joined("steps").alias("steps"))


@query("""SELECT c_custkey, coalesce(steps, '') AS steps, coalesce(calls, 0) AS calls, coalesce(logs, 0) AS logs FROM customer
    LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey || ':' || coalesce(n, 0) || ':' || coalesce(p, ''), ';' ORDER BY o_orderkey) AS steps FROM orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) FILTER (event_type <> 'error') AS calls, count(*) FILTER (event_type = 'error') AS logs FROM events GROUP BY 1) ON user_id = c_custkey""")
def a12_extraction_detail(t):
    """Steps with their page count and all pages, calls and logs in one plan: no query for each step."""
    steps = nested.with_list(t.orders.select("o_custkey", "o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", [F.col("l_partkey")], F.col("l_partkey"), "pages")
    shown = F.concat_ws(":", F.col("o_orderkey").cast("string"), F.size("pages").cast("string"), _joined("pages"))
    full = nested.with_list(t.customer.select("c_custkey"), steps.withColumn("shown", shown), "c_custkey", "o_custkey", [F.col("o_orderkey")], F.col("shown"), "steps")
    events = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count_if(F.col("event_type") != "error").alias("calls"), F.count_if(F.col("event_type") == "error").alias("logs"))
    return full.join(events, "c_custkey", "left").select("c_custkey", F.array_join("steps", ";").alias("steps"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("logs", F.lit(0)).alias("logs"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k BETWEEN 3 AND 7")
def a13_logs_page(t):
    """The second page of five logs of every extraction, latest first."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.where("event_type = 'error'").withColumn("k", k).where("k between 3 and 7").select("event_id", "user_id")


@query("SELECT l_partkey, count(*) AS items FROM lineitem GROUP BY 1")
def a16_items_count(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("items"))


@query("""SELECT o_orderkey, o_custkey, c_name, n_name, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
    JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE place <= 20""")
def a21_pages_of_step(t):
    """The first page of 20 of each step, every row with its step and what that belongs to."""
    from pyspark.sql import Window as W

    pages = t.orders.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).where("place <= 20")
    return pages.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "o_custkey", "c_name", "n_name", "place")


@query("""SELECT n_nationkey, coalesce(c, '') AS catalogues FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_custkey || '[' || coalesce(r, '') || ']', ';' ORDER BY c_acctbal DESC, c_custkey) AS c FROM customer
    LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey""")
def a25_institution(t):
    """Catalogues in descending order, each with its recipes."""
    inner = nested.with_list(t.customer, t.orders, "c_custkey", "o_custkey", [F.col("o_orderkey")], F.col("o_orderkey"), "recipes")
    shown = F.concat(F.col("c_custkey").cast("string"), F.lit("["), _joined("recipes"), F.lit("]"))
    full = nested.with_list(t.nation, inner.withColumn("shown", shown), "n_nationkey", "c_nationkey", [-F.col("c_acctbal"), F.col("c_custkey")], F.col("shown"), "catalogues")
    return full.select("n_nationkey", F.array_join("catalogues", ";").alias("catalogues"))


@query("SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS recipe FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a26_default_recipe(t):
    """The default recipe of each catalogue, its own and no other's; null where it has none."""
    found = nested.first_or_default(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"), F.col("o_orderkey"), "recipe")
    return t.customer.select("c_custkey").join(found, "c_custkey", "left")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN '[redacted]' ELSE json_extract_string(props, '$.k') END AS value FROM events")
def a27_settings(t):
    """A sealed setting (of a click) is redacted unless it is to be opened; others are read as JSON."""
    return t.events.select("event_id", urls.setting(F.col("props"), F.col("event_type") == "click", F.lit(False), "$.k").alias("value"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem) OR s_acctbal > 0")
def a28_users(t):
    """Users without what is secret (the balance), by id or by another unique column."""
    used = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("used", F.lit(True))
    return t.supplier.join(used, "s_suppkey", "left").where(F.coalesce("used", F.lit(False)) | (F.col("s_acctbal") > 0)).select("s_suppkey", "s_name")


_HOST = "www.shop.france.example.org:8080"


@query("""SELECT n_nationkey, customers, score FROM (SELECT *, CASE WHEN h = d THEN 3 WHEN h LIKE '%.' || d OR d LIKE '%.' || h THEN 2 WHEN contains(h, d) THEN 1 ELSE 0 END AS score, CASE WHEN score > 0 THEN length(d) ELSE 0 END AS len FROM
    (SELECT n_nationkey, n_name, lower(replace(n_name, ' ', '-')) || CASE WHEN n_nationkey % 2 = 0 THEN '.example.org' ELSE '' END AS d, 'shop.france.example.org' AS h, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation)
    ) ORDER BY score DESC, len DESC, n_name LIMIT 10 OFFSET 1""")
def a31_ranked_by_url(t):
    """Institutions with their catalogues, ranked by how well their domain fits a URL's host, then cut to a page."""
    host = F.regexp_replace(urls.host(F.lit(f"https://{_HOST}/list?x=1")), "^www[.]", "")
    domain = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.when(F.col("n_nationkey") % 2 == 0, ".example.org").otherwise(""))
    counted = rel.with_count(t.nation, t.customer, "n_nationkey", "c_nationkey", "customers").withColumn("score", text.domain_match(domain, host)).withColumn("len", F.when(F.col("score") > 0, F.length(domain)).otherwise(0))
    return rel.page(counted, [F.desc("score"), F.desc("len"), F.col("n_name")], 10, 1).select("n_nationkey", "customers", "score")


_CALLS = """(SELECT *, user_id AS extraction, event_id % 3 AS dataset0, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 END AS dataset, CASE WHEN event_id % 2 = 0 THEN 'gpt-4o' ELSE 'o3-mini' END AS model, json_extract_string(props, '$.k')::BIGINT AS tokens_in, event_id % 50 AS tokens_out FROM events)"""
_SUMMARY = f"""SELECT extraction, event_type AS site, model, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM {_CALLS} c
    JOIN (SELECT extraction AS e, max(dataset) AS latest FROM {_CALLS} GROUP BY 1) ON e = extraction WHERE latest IS NULL OR dataset IS NULL OR dataset = latest GROUP BY 1, 2, 3"""


def call_summary(t):
    """Tokens by call site and model of each extraction: those of its latest dataset and of none."""
    calls = t.events.select(F.col("user_id").alias("extraction"), F.col("event_type").alias("site"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3).alias("dataset"), F.when(F.col("event_id") % 2 == 0, "gpt-4o").otherwise("o3-mini").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"))
    by = calls.groupBy("extraction", "site", "model", "dataset").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    last = by.groupBy("extraction").agg(F.max("dataset").alias("latest"))
    mine = by.join(last, "extraction").where("latest is null or dataset is null or dataset = latest")
    return mine.groupBy("extraction", "site", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query(_SUMMARY)
def a34_call_sites(t):
    return call_summary(t)


@query(f"SELECT extraction, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM ({_SUMMARY}) GROUP BY 1")
def a45_detail_totals(t):
    return call_summary(t).groupBy("extraction").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query(f"""SELECT extraction, site, round(sum(tokens_in / 1e6 * p_in + tokens_out / 1e6 * p_out), 9) AS cost FROM ({_SUMMARY}) JOIN (VALUES {", ".join(map(str, PRICES))}) AS p(name, p_in, p_out) ON model = name GROUP BY 1, 2""")
def a37_costs(t):
    """What each call site of each extraction has cost."""
    prices = F.broadcast(t.spark.createDataFrame(PRICES, "model string, p_in double, p_out double"))
    cost = F.col("tokens_in") / 1e6 * F.col("p_in") + F.col("tokens_out") / 1e6 * F.col("p_out")
    return call_summary(t).join(prices, "model").groupBy("extraction", "site").agg(F.round(F.sum(cost), 9).alias("cost"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def a36_no_data_pages(t):
    """Pages of all steps that were begun (not of the lowest priority) and have no item in the latest dataset (flag A)."""
    return rel.by_sort(t.orders.where("o_orderpriority <> '5-LOW'"), t.lineitem.where("l_returnflag = 'A'"), "o_orderkey", "l_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 0) AS total FROM nation WHERE n_nationkey IN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 0 ORDER BY 1 LIMIT 10 OFFSET 2)")
def a40_with_data_total(t):
    ids = t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    # One row.
    total = F.broadcast(ids.agg(F.count(F.lit(1)).alias("total")))
    return t.nation.join(rel.page(ids, [F.col("n_nationkey")], 10, 2), "n_nationkey", "left_semi").crossJoin(total).select("n_nationkey", "n_name", "total")


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed, coalesce(sum(n) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS items,
    date_diff('second', min(o_orderdate), max(o_orderdate)) AS seconds FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def a44_mail_totals(t):
    """What the mail about an ended extraction says: successes, failures, items and how long it took."""
    o = rel.with_count(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "n")
    done = F.col("o_orderstatus") == "F"
    span = F.unix_timestamp(F.max("o_orderdate").cast("timestamp")) - F.unix_timestamp(F.min("o_orderdate").cast("timestamp"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"), F.coalesce(F.sum(F.when(done, F.col("n"))), F.lit(0)).alias("items"), span.alias("seconds"))


@query("WITH n AS (SELECT 'copy of ' || s_name AS s_name FROM supplier WHERE s_acctbal > 0) SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_name) AS s_suppkey, s_name, 0.0::DOUBLE AS s_acctbal FROM n")
def a60_append(t):
    """New rows get the next keys and a default for what they leave out, and come back as they were written."""
    new = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("copy of "), F.col("s_name")).alias("s_name"))
    table, added = writes.append(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), new, "s_suppkey", s_acctbal=F.lit(0.0))
    return table.join(added.select("s_suppkey"), "s_suppkey", "left_semi")


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'unknown error' WHEN event_type = 'error' THEN 'Error: ' || floor(value)::BIGINT ELSE event_type END AS message FROM events")
def a61_safe_log(t):
    """An error becomes a log line whatever it holds: nothing to say is said as such, and no row fails the job."""
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), F.floor("value").cast("string"))).otherwise(F.col("event_type"))
    return t.events.select("event_id", F.when(F.col("value").isNull(), "unknown error").otherwise(F.coalesce(said, F.lit("unknown error"))).alias("message"))


@query("""SELECT l_orderkey, CASE WHEN blank IS NULL AND NOT twice THEN n ELSE 0 END AS pages, CASE WHEN blank IS NOT NULL THEN 'blank URL at ' || blank WHEN twice THEN 'a URL occurs twice' END AS error FROM
    (SELECT l_orderkey, count(*) AS n, min(l_linenumber) FILTER (l_quantity < 3) AS blank, count(DISTINCT l_suppkey) FILTER (l_quantity >= 3) < count(*) FILTER (l_quantity >= 3) AS twice FROM lineitem GROUP BY 1)""")
def a62_checked_steps(t):
    pages = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 3, "  ").otherwise(F.concat(F.lit("https://x.edu/"), F.col("l_suppkey").cast("string"))).alias("url"))
    return writes.checked_steps(pages, "l_orderkey", "l_linenumber", "url")


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def a63_update_by_id(t):
    return writes.update(t.supplier, F.col("s_suppkey") == 3, s_name=F.lit("renamed"), s_acctbal=F.lit(None).cast("double")).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT count(*) AS reset FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 3 = 0")
def a64_reset_count(t):
    """How many rows the guarded update of A64 changes."""
    return t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0)).agg(F.count(F.lit(1)).alias("reset"))


@query("""SELECT o_orderkey, CASE WHEN max((o_orderstatus = 'P')::INT) OVER (PARTITION BY o_custkey) = 1 THEN o_orderstatus = 'P' ELSE o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) END AS is_default FROM orders""")
def a66_set_default_if_none(t):
    """A catalogue without a default recipe (status P) gets its first one; one that has some keeps these."""
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    marked = t.orders.withColumn("is_default", F.col("o_orderstatus") == "P").join(first, "o_custkey")
    return writes.set_if_none(marked, "is_default", "o_custkey", F.col("o_orderkey") == F.col("first")).select("o_orderkey", "is_default")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, min(n_name) FROM nation WHERE n_nationkey >= 20 GROUP BY 1")
def a67_insert_missing(t):
    """Keys that are there stay as they are; new keys are added once, though they come twice."""
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    far = old.where("n_nationkey >= 20").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    return writes.insert_missing(old, old.withColumn("n_name", F.lit("other")).unionByName(far).unionByName(far.withColumn("n_name", F.lit("~"))), "n_nationkey")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'OFF' WHEN event_id % 3 = 0 THEN 'MINE' ELSE 'ALWAYS' END AS mail, CASE WHEN event_id % 3 = 0 THEN 'dark' ELSE 'light' END AS theme, CASE WHEN event_id % 5 = 0 THEN props END AS extra FROM events""")
def a69_deep_merge(t):
    """Defaults under what is stored under the patch, leaf by leaf."""
    stored = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("mail"), F.lit("MINE"), F.lit("theme"), F.lit("dark")))
    patch = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("mail"), F.lit("OFF"), F.lit("extra"), F.col("props")))
    merged = nested.deep_merge(F.create_map(F.lit("mail"), F.lit("ALWAYS"), F.lit("theme"), F.lit("light")), stored, patch)
    return t.events.select("event_id", *(merged[k].alias(k) for k in ("mail", "theme", "extra")))


@query(f"SELECT page_id, dense_rank() OVER (ORDER BY regexp_extract({DOMAIN}, '([^.]*[.][^.]*)$', 1)) AS institution FROM pages")
def a70_update_any(t):
    """Institutions out of the pages' domains, one for each registered name; then each page is given the institution that
    its domain's name has."""
    name = F.regexp_extract(text.normalize_domain(F.col("url")), "([^.]*[.][^.]*)$", 1).alias("name")
    numbered = ranks.numbered(t.pages.select(name).distinct(), ["name"], "institution")
    return t.pages.select("page_id", name).join(numbered, "name").select("page_id", "institution")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(o_orderpriority, 'none') AS step FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def a71_fill_step(t):
    """Pages take over the step of the row that they belong to."""
    filled = rel.by_sort(t.lineitem, t.orders.select("o_orderkey", "o_orderpriority"), "l_orderkey", "o_orderkey", "left")
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("o_orderpriority", F.lit("none")).alias("step"))
