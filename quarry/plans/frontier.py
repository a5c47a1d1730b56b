"""Links, answers, entities and the states of a crawl, over pages, documents and recorded answers (events, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import extraction as ex, robots, text, urls
from quarry.operators import relational as rel
from quarry.plans.catalogue import query

_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_MD = "'see [one](/c/' || page_id || ') and [two](' || chr(63) || 'p=2) at https://o.org/z/1 then /c/' || page_id || ' /d/9 /d/9 end'"


@query(f"""SELECT page_id, '/c/' || page_id || ' https://o.org/z/1 ' || {_ORIGIN} || '/d/9' AS links, './c/' || page_id || ' https://o.org/z/1 ' || {_ORIGIN} || '/d/9' AS exact FROM pages""")
def b05_links_of_page(t):
    """Markdown links win over bare matches, absolute ones stay, repeated ones go; the order is that of the page."""
    page = F.col("page_id").cast("string")
    md = F.concat(F.lit("see [one](/c/"), page, F.lit(") and [two](?p=2) at https://o.org/z/1 then /c/"), page, F.lit(" /d/9 /d/9 end"))
    found = {k: ex.page_links(md, F.lit(r"(?:https?://[a-z.]+)?/[cdz]/\d+"), F.col("url"), F.lit(k == "exact")) for k in ("links", "exact")}
    return t.pages.select("page_id", *(F.array_join(c, " ").alias(k) for k, c in found.items()))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE n_nationkey END AS pages, CASE n_nationkey % 4 WHEN 0 THEN 'blank pattern' WHEN 1 THEN 'pattern has no {page_num}' END AS error,
    CASE WHEN n_nationkey % 4 = 3 THEN 'https://x.edu/1/{page_num}' END AS first FROM nation""")
def b06_page_url_errors(t):
    k = F.col("n_nationkey") % 4
    pattern = F.when(k == 0, "  ").when(k == 1, "https://x.edu/?page=1").when(k == 2, "https://x.edu/?from={offset}").otherwise(" https://x.edu/{page_num}/{page_num}")
    made = text.page_urls(pattern, F.col("n_nationkey"), None, F.when(k == 2, "offset"))
    return t.nation.select("n_nationkey", made.alias("m")).select("n_nationkey", F.when(F.col("m.urls").isNotNull(), F.size("m.urls")).alias("pages"), "m.error", F.try_element_at("m.urls", F.lit(1)).alias("first"))


@query("""SELECT event_id, CASE WHEN n >= 1 THEN floor(n)::BIGINT END AS pages, CASE WHEN n >= 1 THEN NULL ELSE 'bad page count' END AS error FROM
    (SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN value WHEN 'error' THEN -2 END, CASE WHEN event_id % 3 = 0 THEN event_id % 20 END) AS n FROM events)""")
def b07_page_counts(t):
    """The answer's count, else the recipe's; one of neither, or below 1, is an error of the row."""
    answer = F.when(F.col("event_type") == "view", F.col("value").cast("string")).when(F.col("event_type") == "error", "-2").otherwise("many")
    return t.events.select("event_id", ex.page_count(answer, F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 20)).alias("x")).select("event_id", "x.pages", "x.error")


@query(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://p.org/a' WHEN 1 THEN {_ORIGIN} || '/up/b' ELSE url END AS base FROM pages""")
def b09_base_urls(t):
    k = F.col("page_id") % 3
    return t.pages.select("page_id", ex.base_url(F.when(k == 0, "https://p.org/a").when(k == 1, "/up/b").otherwise(""), F.col("url")).alias("base"))


@query("""SELECT page_id, string_agg(CASE k WHEN 1 THEN 'HTTPS://' || upper(h) ELSE 'https://' || h || CASE k WHEN 2 THEN '/b' ELSE '/B' END END, ' ' ORDER BY k) AS urls FROM
    (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h, unnest([1, 2, 3]) AS k FROM pages) GROUP BY 1""")
def b10_urls_once(t):
    """The first of the URLs that are the same once normalised stays as it was written; what is no URL goes."""
    h = F.lower(F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    given = F.array(F.concat(F.lit("HTTPS://"), F.upper(h)), F.concat(F.lit("https://"), h, F.lit("/b")), F.lit("no url"), F.concat(F.lit("https://"), h, F.lit("/")), F.concat(F.lit("https://"), h, F.lit("/B")), F.concat(F.lit("HTTPS://"), h, F.lit("/b")))
    good = F.filter(given, lambda u: ex.normal_url(u).isNotNull())
    return t.pages.select("page_id", F.array_join(ex.kept_first(good, ex.normal_url), " ").alias("urls"))


@query(f"""SELECT page_id, {_ORIGIN} || '/in/' || page_id AS near, {_ORIGIN} || '/in/' || page_id || ' https://far.org/x' AS far FROM pages""")
def b12_explored(t):
    page = F.concat(F.lit("go to /in/"), F.col("page_id").cast("string"), F.lit(" or https://far.org/x"))
    answer = F.array(F.concat(F.lit("/in/"), F.col("page_id").cast("string")), F.lit("/made/up"), F.lit("https://far.org/x"), F.concat(F.lit("/in/"), F.col("page_id").cast("string")))
    return t.pages.select("page_id", *(F.array_join(ex.explored(answer, page, F.col("url"), F.lit(k == "near")), " ").alias(k) for k in ("near", "far")))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '*:/a,/b:/a/ok:2.5' WHEN 1 THEN 'beta:/x::' WHEN 2 THEN '' WHEN 3 THEN '*:/one::;*:/two::' ELSE 'alpha::/y:' END AS rules, CASE WHEN n_nationkey % 5 = 4 THEN 'https://x.edu/map.xml' ELSE '' END AS sitemaps,
    CASE n_nationkey % 5 WHEN 0 THEN '/a,/b' WHEN 3 THEN '/one' END AS star FROM nation""")
def b14_robots_rules(t):
    """Of grouped agents the last has the rules; fields without a value, comments and unknown fields count for nothing;
    of several rules for all agents the first is theirs."""
    k = F.col("n_nationkey") % 5
    body = F.when(k == 0, "User-Agent: *  # all\nDISALLOW: /a\ndisallow:/b\nDisallow:\nAllow: /a/ok\ncrawl-delay: 2.5\n").when(k == 1, "user-agent: alpha\nuser-agent: beta\nnoindex: /q\ndisallow: /x").when(k == 2, "# nothing\n\nDisallow: /early\n").when(k == 3, "User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two").otherwise("User-agent: alpha\nAllow: /y\nSitemap: https://x.edu/map.xml")
    parsed = t.nation.select("n_nationkey", robots.parsed()(body).alias("r"))

    def shown(rule):
        return F.concat_ws(":", rule["agent"], F.array_join(rule["disallow"], ","), F.array_join(rule["allow"], ","), F.coalesce(rule["delay"].cast("string"), F.lit("")))

    star = F.try_element_at(F.filter("r.rules", lambda x: x["agent"] == "*"), F.lit(1))
    return parsed.select("n_nationkey", F.array_join(F.transform("r.rules", shown), ";").alias("rules"), F.array_join("r.sitemaps", ",").alias("sitemaps"), F.when(star.isNotNull(), F.array_join(star["disallow"], ",")).alias("star"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 AND p_size > 10 THEN (p_size - 10) * 500 ELSE 3000 END::BIGINT AS interval_ms FROM part")
def b17_intervals(t):
    """A host's own delay where it has a rule that allows the URL and a delay above 0; else three seconds."""
    size = F.col("p_size")
    return t.part.select("p_partkey", ex.interval_ms(size % 2 == 0, size % 3 != 0, (size - 10) / F.lit(2.0)).alias("interval_ms"))


@query("SELECT doc_id, (lang IS NULL OR contains(text, lang)) AND (source IS NULL OR contains(text, source)) AND contains(text, 'the') AND contains(text, ' of ') AS passed FROM documents")
def b21_all_fields(t):
    flags = {"lang": (F.col("lang"), F.contains("text", "lang")), "source": (F.col("source"), F.contains("text", "source")), "phrase": (F.lit("the"), F.contains("text", F.lit("the"))), "other": (F.lit(" of "), F.contains("text", F.lit(" of ")))}
    return t.documents.select("doc_id", text.passes(flags, list(flags)).alias("passed"))


@query("SELECT doc_id, coalesce(lang, '') = 'en' AND n_chars // 4 > 1000 AND doc_id % 3 <> 0 AS chunked FROM documents")
def b23_should_chunk(t):
    kind = F.when(F.col("lang") == "en", "COURSES").otherwise("CREDENTIALS")
    several = F.when(F.col("doc_id") % 3 == 0, False).when(F.col("doc_id") % 3 == 1, True)
    return t.documents.select("doc_id", ex.should_chunk(kind, F.expr("n_chars div 4"), several).alias("chunked"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE 3 END AS chunks, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Course ' || page_id || ' one' END AS first, CASE WHEN page_id % 4 = 0 THEN page_id % 5 = 0 ELSE page_id % 5 = 3 END AS accepted FROM pages""")
def b24_split_chunks(t):
    """Blank parts go, and those before the first title; then their number is held against what is expected."""
    page = F.col("page_id").cast("string")
    body = F.concat(F.lit("menu\n---\n  \n---\nCourse "), page, F.lit(" one\n---\ntwo\n---\n\n---\nthree"))
    title = F.when(F.col("page_id") % 4 == 0, "Missing title").otherwise(F.concat(F.lit("COURSE-"), page, F.lit(" One")))
    got = t.pages.select("page_id", ex.chunks(body, "\n---\n", title, F.col("page_id") % 5).alias("x"))
    return got.select("page_id", F.size("x.chunks").alias("chunks"), F.coalesce(F.try_element_at("x.chunks", F.lit(1)), F.lit("")).alias("first"), "x.accepted")


_ENTITY = """SELECT p_partkey, 'C' || p_partkey AS course_id, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS course_name, p_type AS course_description, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS course_prerequisites,
    CASE WHEN p_size % 2 = 0 AND p_size % 7 <> 0 THEN 'SemesterHour' END AS course_credits_type, CASE WHEN p_size % 5 <> 0 THEN (p_size % 5)::DOUBLE END AS course_credits_min, CASE WHEN p_size % 3 = 0 THEN 4.5 END::DOUBLE AS course_credits_max FROM part"""


def entities(t):
    size = F.col("p_size")
    raw = {
        "course_id": F.concat(F.lit("C"), F.col("p_partkey").cast("string")), "course_name": F.when(size % 9 == 0, "").otherwise(F.col("p_name")), "course_description": F.col("p_type"),
        "course_prerequisites": F.when(size % 4 == 0, "  ").otherwise(F.col("p_brand")), "course_credits_type": F.when(size % 2 == 0, "SemesterHour").otherwise("Invented"), "course_non_credit": size % 7 == 0,
        "course_credits_min": F.when(size % 5 == 0, "none").otherwise(F.concat((size % 5).cast("string"), F.lit(" hours"))), "course_credits_max": F.when(size % 3 == 0, "4.5"),
    }
    return t.part.select("p_partkey", "p_size", "p_type", *(c.alias(k) for k, c in ex.course_entity(raw).items()))


@query(_ENTITY)
def b25_course_entities(t):
    return entities(t).drop("p_size", "p_type")


@query(f"SELECT p_partkey, course_name FROM ({_ENTITY}) WHERE course_name <> ''")
def b26_complete_entities(t):
    """Of the answers of a call those with all required values stay."""
    return entities(t).where(ex.complete([F.col(c) for c in ("course_id", "course_name", "course_description")])).select("p_partkey", "course_name")


@query("""SELECT doc_id, k AS chunk, n_words, contains(regexp_replace(lower(c), '[^a-z0-9]', '', 'g'), regexp_replace(lower(w), '[^a-z0-9]', '', 'g')) AS included FROM
    (SELECT doc_id, k, c, string_split(c, ' ')[1] AS w, len(string_split(c, ' ')) AS n_words FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS c FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)))""")
def b27_extract_and_verify(t):
    """Chunks, an entity of each (its first word and its number of words), and whether the chunk holds it."""
    parts = F.filter(F.split("text", "\n"), lambda c: F.trim(c) != "")
    each = t.documents.select("doc_id", F.posexplode(parts).alias("at", "c")).withColumn("w", F.split("c", " "))
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("chunk"), F.size("w").cast("long").alias("n_words"), text.included(F.col("c"), F.element_at("w", 1)).alias("included"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'net::ERR_CONNECTION_REFUSED' WHEN 380 + p_size < 400 THEN NULL ELSE CASE 380 + p_size WHEN 400 THEN 'Bad Request' WHEN 401 THEN 'Unauthorized' WHEN 403 THEN 'Forbidden' WHEN 404 THEN 'Not Found' WHEN 407 THEN 'Proxy related error' ELSE 'HTTP ' || (380 + p_size) END END AS reason, CASE WHEN p_size % 5 = 0 THEN 'WAITING' WHEN p_partkey % 7 = 0 OR 380 + p_size >= 400 THEN 'ERROR' ELSE 'DOWNLOADED' END AS status, p_size % 5 <> 0 AND (p_partkey % 7 = 0 OR 380 + p_size IN (402, 403, 407)) AS again FROM part")
def c02_fetch_outcomes(t):
    """B35's reasons in C2's states: nothing for a cancelled extraction, for good after a client error, else again."""
    size = F.col("p_size")
    made = ex.fetch_outcome(size % 5 == 0, size + 380, F.when(F.col("p_partkey") % 7 == 0, "net::ERR_CONNECTION_REFUSED"))
    return t.part.select("p_partkey", *(c.alias(k) for k, c in made.items()))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'aa' || page_id || CASE WHEN page_id % 2 = 0 THEN ' bb' ELSE '' END WHEN page_id % 2 = 0 THEN 'bb' ELSE '' END AS schools, page_id % 3 = 0 OR page_id % 2 = 0 AS is_vendor FROM pages""")
def b36_school_ids(t):
    """A vendor's page names the school in one of two ways."""
    page = F.concat(F.col("html"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<i data-school="aa'), F.col("page_id").cast("string"), F.lit('">'))).otherwise(""), F.when(F.col("page_id") % 2 == 0, '{"schoolId":"bb"}').otherwise(""))
    ids = ex.school_ids(page, ['data-school="([^"]+)"', '"schoolId":"([^"]+)"'])
    return t.pages.select("page_id", F.array_join(ids, " ").alias("schools"), (F.size(ids) > 0).alias("is_vendor"))


@query("SELECT o_custkey, count(*) % 2 = 0 AS same FROM orders GROUP BY 1")
def b49_multisets(t):
    """The statuses of an extraction against themselves from behind, one less where their number is odd."""
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("l"))
    other = F.reverse(F.slice("l", 1, F.size("l") - F.size("l") % 2))
    return lists.select("o_custkey", ex.same_multiset(F.col("l"), other).alias("same"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey < 1000 THEN o_custkey::VARCHAR ELSE (o_custkey // 1000) || CASE WHEN o_custkey % 1000 >= 100 THEN '.' || (o_custkey % 1000 // 100) ELSE '' END || 'K' END AS shown,
    CASE o_orderstatus WHEN 'F' THEN 'Learning Programs' ELSE 'Courses' END AS label, 'https://x.edu/a/' || o_orderkey AS url, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders""")
def b52_labels(t):
    kind = F.when(F.col("o_orderstatus") == "F", "LEARNING_PROGRAMS").otherwise("COURSES")
    return t.orders.select("o_orderkey", ex.thousands(F.col("o_custkey")).alias("shown"), ex.label(kind).alias("label"), ex.joined_url(F.lit("https://x.edu//"), F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string"))).alias("url"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))


@query("""WITH v AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'DETAIL' WHEN 'click' THEN 'CATEGORY_LINKS' ELSE 'DETAIL_LINKS' END AS kind, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT user_id, kind, count(*) AS n, max(k) AS reached FROM v WHERE k <= 10 GROUP BY 1, 2), w AS (SELECT user_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, reached) AS r FROM c) WHERE r = 1),
    s AS (SELECT user_id, min(kind) AS lo, max(kind) AS hi FROM v WHERE k BETWEEN 11 AND 15 GROUP BY 1)
    SELECT user_id, kind AS root, CASE WHEN kind = 'DETAIL' THEN NULL WHEN lo = hi THEN lo END AS child, CASE WHEN kind = 'DETAIL' THEN NULL WHEN lo = hi THEN NULL ELSE 'answers differ' END AS error FROM w LEFT JOIN s USING (user_id)""")
def b_det_configuration(t):
    """Vote of ten on the root; a page of details ends it; else five children of the next level must all agree."""
    from quarry.operators import retries

    kind = F.when(F.col("event_type") == "view", "DETAIL").when(F.col("event_type") == "click", "CATEGORY_LINKS").otherwise("DETAIL_LINKS")
    calls = t.events.select("user_id", "event_id", kind.alias("kind"))
    root = retries.voted(calls, "user_id", "event_id", "kind", 10, "DETAIL").withColumnRenamed("kind", "root")
    level = ex.agreed(retries.first_calls(calls, "user_id", "event_id", 15).where("try > 10"), "user_id", "kind").withColumnRenamed("kind", "child")
    ends = F.col("root") == "DETAIL"
    return root.join(level, "user_id", "left").select("user_id", "root", F.when(~ends, F.col("child")).alias("child"), F.when(~ends, F.when(F.col("child").isNull(), "answers differ")).alias("error"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no such recipe' WHEN o_orderstatus <> 'F' THEN 'recipe is not ready' END AS error, CASE WHEN c_custkey IS NOT NULL AND o_orderstatus = 'F' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'api' ELSE 'fetch' END END AS job,
    c_custkey IS NOT NULL AND o_orderstatus = 'F' AS audited FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def c01_start(t):
    """A recipe must be its catalogue's (with a balance) and ready; then the root job and an audit row are made."""
    there, ready = F.col("c_custkey").isNotNull(), F.col("o_orderstatus") == "F"
    joined = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    error = F.when(~there, "no such recipe").when(~ready, "recipe is not ready")
    return joined.select("o_orderkey", error.alias("error"), F.when(error.isNull(), F.when(F.col("o_orderpriority").startswith("1"), "api").otherwise("fetch")).alias("job"), error.isNull().alias("audited"))


@query("""SELECT n_nationkey AS step, 'https://x.edu/l?page=' || i AS url, 'FETCH_PAGINATED' AS kind, 'CATEGORY_LINKS' AS page_type, -i AS priority FROM nation, range(1, 26) r(i) WHERE i <= n_nationkey""")
def c04_paginated_steps(t):
    """The pages of a paginated level as rows of one step; the last in is the first out."""
    made = t.nation.select(F.col("n_nationkey").alias("step"), F.posexplode(text.page_urls(F.lit("https://x.edu/l?page={page_num}"), F.col("n_nationkey"))["urls"]).alias("at", "url"))
    return made.select("step", "url", F.lit("FETCH_PAGINATED").alias("kind"), F.lit("CATEGORY_LINKS").alias("page_type"), (-(F.col("at") + 1)).cast("long").alias("priority"))


@query(f"""WITH l AS (SELECT page_id, {_ORIGIN} || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link, url FROM pages)
    SELECT DISTINCT page_id AS parent, link AS url, 'FETCH_LINKS' AS kind, 'DETAIL' AS page_type FROM l
    WHERE NOT EXISTS (SELECT 1 FROM pages h WHERE h.url = l.link) AND page_id = (SELECT min(m.page_id) FROM l m WHERE m.link = l.link)""")
def c05_link_steps(t):
    """Links of all pages, less those whose page the extraction has, as a step's rows; each is the step of the first page
    that has it."""
    links = t.pages.select("page_id", F.explode(F.transform(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)), lambda p: F.concat(urls.origin(F.col("url")), p))).alias("url"))
    first = links.groupBy("url").agg(F.min("page_id").alias("parent"))
    return first.join(t.pages.select("url"), "url", "left_anti").select("parent", "url", F.lit("FETCH_LINKS").alias("kind"), F.lit("DETAIL").alias("page_type"))


@query("""SELECT l_orderkey, count(*) FILTER (there) AS items, CASE WHEN any_value(stop) THEN 'IN_PROGRESS' WHEN count(*) FILTER (there) > 0 THEN 'SUCCESS' ELSE 'EXTRACTED_NO_DATA' END AS status,
    NOT any_value(stop) AND count(*) FILTER (there) > 0 AND any_value(depth) <= 8 AS explore FROM (SELECT l_orderkey, l_orderkey % 11 = 0 AS stop, l_orderkey % 12 AS depth, l_orderkey % 11 <> 0 AND l_returnflag = 'R' AND l_quantity > 20 AS there FROM lineitem) GROUP BY 1""")
def c07_extracted_pages(t):
    """Entities (flag R) that pass the gate (quantity) are items; a page of a cancelled extraction stays as it was; only
    pages with items, at most eight steps deep, are explored."""
    stop = F.col("l_orderkey") % 11 == 0
    there = ~stop & (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 20)
    by = t.lineitem.groupBy("l_orderkey").agg(F.count_if(there).alias("items"))
    status = F.when(stop, "IN_PROGRESS").when(F.col("items") > 0, "SUCCESS").otherwise("EXTRACTED_NO_DATA")
    return by.select("l_orderkey", "items", status.alias("status"), (~stop & (F.col("items") > 0) & (F.col("l_orderkey") % 12 <= 8)).alias("explore"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error')::BIGINT AS items, 8 AS verified, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 400) > 0 THEN 'ERROR' ELSE 'SUCCESS' END AS page, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 400) > 0 THEN 'CANCELLED' ELSE 'COMPLETE' END AS extraction FROM events GROUP BY 1")
def c08_api_extraction(t):
    """An interface's batches are items with every field verified, and complete the extraction; an error cancels it."""
    failed = F.count_if((F.col("event_type") == "error") & (F.col("value") > 400)) > 0
    by = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("items"), failed.alias("failed"))
    return by.select("user_id", "items", F.lit(8).alias("verified"), F.when(F.col("failed"), "ERROR").otherwise("SUCCESS").alias("page"), F.when(F.col("failed"), "CANCELLED").otherwise("COMPLETE").alias("extraction"))


@query("""SELECT o_custkey, CASE WHEN cost > 1000000 THEN 'CANCELLED' WHEN same AND whole AND quiet >= 300 AND queued = 0 THEN 'COMPLETE' WHEN same AND NOT whole AND quiet >= 14400 THEN 'STALE' ELSE 'IN_PROGRESS' END AS status FROM
    (SELECT o_custkey, sum(o_totalprice) AS cost, count(*) FILTER (o_orderstatus = 'F') = count(*) AS whole, count(*) % 2 = 0 AS same, o_custkey * 60 AS quiet, count(*) FILTER (o_orderpriority LIKE '1%') % 3 AS queued FROM orders GROUP BY 1)""")
def c09_looks(t):
    """One look at each extraction: the budget first, then completeness with the time to settle, then staleness."""
    from quarry.streaming import completion

    o = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("cost"), (F.count_if(F.col("o_orderstatus") == "F") == F.count(F.lit(1))).alias("whole"), (F.count(F.lit(1)) % 2 == 0).alias("same"), (F.count_if(F.col("o_orderpriority").startswith("1")) % 3).alias("queued"))
    return o.select("o_custkey", completion.decided(F.lit("IN_PROGRESS"), F.col("cost"), F.lit(1e6), F.col("same"), F.col("whole"), F.col("o_custkey") * 60, F.col("queued")).alias("status"))


@query("""SELECT o_orderkey, o_custkey, dataset FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AND (o_orderstatus = 'P' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))), (VALUES (0), (1)) d(dataset)""")
def c10_retry_failed(t):
    """Failed or empty pages of complete extractions (customers who owe nothing) are fetched again for every dataset (two)."""
    complete = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    some = t.orders.join(complete, "o_custkey", "left_semi").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("full", F.lit(True)), "o_orderkey", "left")
    again = some.where("o_orderstatus = 'P' or full is null")
    return again.select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("dataset"))


@query("""SELECT c_custkey, count(o_orderkey) AS jobs, ceil(count(o_orderkey) / 20.0)::BIGINT AS batches, CASE WHEN count(o_orderkey) = 0 THEN 'no pages' END AS error FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IN ('F', 'O') GROUP BY 1""")
def c11_rerun(t):
    """All valid pages go into a new dataset, twenty jobs at a time; an extraction without any is an error, not a crash."""
    full = rel.with_count(t.customer, t.orders.where("o_orderstatus in ('F', 'O')"), "c_custkey", "o_custkey", "jobs")
    return full.select("c_custkey", "jobs", F.ceil(F.col("jobs") / 20).alias("batches"), F.when(F.col("jobs") == 0, "no pages").alias("error"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 < 2 THEN 'not resumable' WHEN o_orderpriority LIKE '1%' THEN 'api' ELSE NULL END AS refused, CASE WHEN o_custkey % 4 >= 2 AND o_orderpriority NOT LIKE '1%' AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status,
    o_custkey % 4 >= 2 AND o_orderpriority NOT LIKE '1%' AND o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AS enqueued FROM orders""")
def c12_resume_all(t):
    """Only stale or cancelled extractions (custkey mod 4 from 2 on) that use no interface: orphans in progress (P) wait
    again (O), and waiting pages that aren't queued (line status F) are."""
    ok, api = F.col("o_custkey") % 4 >= 2, F.col("o_orderpriority").startswith("1")
    queued = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("queued", F.lit(True))
    o = t.orders.join(queued, "o_orderkey", "left")
    status = F.when(ok & ~api & (F.col("o_orderstatus") == "P"), "O").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", F.when(~ok, "not resumable").when(api, "api").alias("refused"), status.alias("status"), (ok & ~api & F.col("o_orderstatus").isin("O", "P") & F.col("queued").isNull()).alias("enqueued"))


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'view' AND value > 10")
def s02_streamed_rows(t):
    """Rows for an export are read partition by partition; nothing gathers them."""
    return t.events.where("event_type = 'view' and value > 10").select("user_id", "event_id", "value")


@query("""SELECT user_id, coalesce(arg_min(event_id, k) FILTER (NOT bad), arg_max(event_id, k)) AS event_id, count(*) FILTER (NOT bad) = 0 AS failed FROM
    (SELECT *, event_id % 5 < 3 OR event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 4 GROUP BY 1""")
def s04_proxy_rotation(t):
    """Four tries of a page, direct and by three proxies: the first that isn't the proxy's fault is the answer."""
    from quarry.operators import retries

    tries = retries.first_calls(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", 4)
    http, said = F.when(F.col("event_id") % 5 < 3, 407).otherwise(200), F.when(F.col("event_type") == "error", "net::ERR_TUNNEL_CONNECTION_FAILED")
    ordered = tries.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("try", "event_id", http.alias("http"), said.alias("message")))).alias("tries"))
    got = ordered.select("user_id", ex.proxied(F.col("tries")).alias("x"))
    return got.select("user_id", "x.event_id", urls.is_proxy_error(F.col("x.http"), F.col("x.message")).alias("failed"))


@query(f"""SELECT p.page_id, {_ORIGIN} || '/robots.txt' AS robots_url, CASE WHEN h.page_id % 3 <> 0 THEN 'User-agent: *' END AS body FROM pages p
    JOIN (SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, min(page_id) AS page_id FROM pages GROUP BY 1) h ON host = lower(regexp_extract(url, '^https?://([^/?#]*)', 1))""")
def s05_robots_by_host(t):
    """robots.txt is looked up once for a host, not once for a page; an answer that isn't 200 is none."""
    hosts = t.pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("first"))
    recorded = hosts.select("host", F.when(F.col("first") % 3 == 0, 404).otherwise(200).alias("http"), F.lit("User-agent: *").alias("text"))
    pages = t.pages.select("page_id", F.concat(urls.origin(F.col("url")), F.lit("/robots.txt")).alias("robots_url"), urls.host(F.col("url")).alias("host"))
    return pages.join(recorded, "host").select("page_id", "robots_url", F.when(F.col("http") == 200, F.col("text")).alias("body"))


@query("""SELECT conv_id, turn, turn // 2 AS page, ceil(count(*) OVER (PARTITION BY conv_id) / 2.0)::BIGINT AS calls, 'C' || conv_id || '-' || turn AS course_id FROM conversations WHERE conv_id IS NOT NULL""")
def s06_vendor_pages(t):
    """A vendor's listings, two rows a page (recorded turns), of all catalogues, as items."""
    asked = t.conversations.where("conv_id is not null")
    calls = asked.groupBy("conv_id").agg(F.ceil(F.count(F.lit(1)) / 2).alias("calls"))
    return asked.join(calls, "conv_id").select("conv_id", "turn", F.expr("turn div 2").alias("page"), "calls", F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("course_id"))


@query("SELECT page_id, md5(html) AS digest, length(html)::BIGINT AS n FROM pages")
def s09_blobs(t):
    """Pages are kept compressed, one row each, in a table that is written and read whole; what comes out is what went in."""
    from quarry.operators import ranks

    return ranks.written(t.pages.select("page_id", "html"), "blobs").select("page_id", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n"))
