"""The part of the catalogue with state between steps: the completion stream, throttling over batches, deep ancestors,
and comparisons of many with many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.functions import chunking, urls
from quarry.operators import forest, matching, ranks, relational as rel, search, similarity
from quarry.operators.frontier import Frontier
from quarry.operators.ranks import written
from quarry.plans import crawl
from quarry.plans.catalogue import HOST, query
from quarry.streaming import watch


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 400 = 7 THEN p_partkey + 1 WHEN p_partkey % 400 = 8 THEN p_partkey - 1 ELSE p_partkey - p_size END AS parent FROM part),
    up AS (SELECT id, id AS node, parent, 1 AS depth FROM n UNION ALL SELECT up.id, n.id, n.parent, depth + 1 FROM up JOIN n ON n.id = up.parent WHERE depth <= (SELECT count(*) FROM n)),
    top AS (SELECT id, max(depth) AS depth, arg_max(node, depth) AS root FROM up GROUP BY id)
    SELECT id, CASE WHEN depth <= (SELECT count(*) FROM n) THEN depth END AS depth, CASE WHEN depth <= (SELECT count(*) FROM n) THEN root END AS root, depth > (SELECT count(*) FROM n) AS cyclic, CASE WHEN depth <= (SELECT count(*) FROM n) THEN depth > 8 END AS too_deep FROM top""")
def a51_any_parents(t):
    """Ancestors in a forest as deep as its parents make it, in which some ways run in circles."""
    k = F.col("p_partkey")
    parent = F.when(k % 400 == 7, k + 1).when(k % 400 == 8, k - 1).otherwise(k - F.col("p_size"))
    return forest.ancestors(t.part.select(k.alias("id"), parent.alias("parent"))).withColumn("too_deep", F.col("depth") > crawl.MAX_DEPTH)


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding::DOUBLE[], lambda e: floor(e * 4 + 0.5) / 4) FROM embeddings),
    c AS (SELECT x, min(id) AS class FROM v GROUP BY x), p AS (SELECT a.class AS a, b.class AS b, list_cosine_similarity(a.x, b.x) AS s FROM c a JOIN c b ON a.class < b.class AND list_cosine_similarity(a.x, b.x) >= 0.85),
    l AS (SELECT class, count(*) AS links, max(s) AS best FROM (SELECT a AS class, s FROM p UNION ALL SELECT b, s FROM p) GROUP BY class)
    SELECT id, class, coalesce(links, 0) AS links, round(best, 5) AS best FROM v JOIN c USING (x) LEFT JOIN l USING (class)""")
def b48_similar(t):
    """All vectors of all labels, and their versions rounded to quarters, joined with what is as similar as 0.85: all
    pairs, in blocks. Many versions are exactly as similar as that."""
    e = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    # Quarters are floats too, and take half the room of doubles.
    rough = e.select((F.col("vec_id") + 1_000_000_000).alias("id"), F.transform("vector", lambda x: F.floor(x.cast("double") * 4 + 0.5) / 4).cast(e.schema["vector"].dataType).alias("vector"))
    found = similarity.linked(e.withColumnRenamed("vec_id", "id").unionByName(rough), 0.85)
    return found.select("id", "class", "links", F.round("best", 5).alias("best"))


@query()
def b49_assignments(t):
    """Each customer's open orders against the filled ones: the same priority, clerks alike, totals within a tenth, each
    order used once. Greedy in order of keys, so a test holds it against a plain walk."""
    rows = t.orders.select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("place"), "o_orderpriority", "o_orderdate", F.round("o_totalprice", -4).alias("total"))
    rows = rows.select("o_custkey", "o_orderstatus", "place", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "total")
    matchers = {"o_orderpriority": matching.same, "month": matching.alike(0.7), "total": matching.near(0.25)}
    sides = [rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("O", "F")]
    return matching.matched(*sides, ["o_custkey"], matchers, ["o_orderpriority"])


@query(f"""SELECT page_id, {HOST} AS host, (row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1) * 3000 AS start_ms FROM pages""")
def c06_throttle_batches(t):
    """Pages arrive in three batches; each begins where the table of hosts' times, kept between them, lets it."""
    pages = t.pages.select("page_id", urls.host(F.col("url")).alias("host"))
    cuts = pages.approxQuantile("page_id", [1 / 3, 2 / 3], 0.01)
    low, high = F.col("page_id") > cuts[0], F.col("page_id") > cuts[-1]
    free, done = t.spark.createDataFrame([], "host string, free_ms long"), []
    for batch in (pages.where(~low), pages.where(low & ~high), pages.where(high)):
        slots, free = crawl.slots_of_batch(batch, free, 3000)
        done.append(slots)
    return reduce(lambda a, b: a.unionByName(b), done).select("page_id", "host", "start_ms")


@query("""WITH l AS (SELECT user_id AS extraction_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 0 END AS done, value AS cost FROM events),
    s AS (SELECT *, row_number() OVER w AS i, lead(ms) OVER w AS following, lag(done) OVER w IS DISTINCT FROM done AS changed FROM l WINDOW w AS (PARTITION BY extraction_id ORDER BY ms, done, cost)),
    d AS (SELECT *, max(CASE WHEN changed THEN ms END) OVER (PARTITION BY extraction_id ORDER BY i) + CASE WHEN done = 2 THEN 300000 ELSE 14400000 END AS due FROM s),
    e AS (SELECT extraction_id, i, CASE WHEN cost > 300 THEN 'CANCELLED' WHEN done = 2 THEN 'COMPLETE' ELSE 'STALE' END AS status, CASE WHEN cost > 300 THEN ms ELSE due END AS ended_ms FROM d WHERE cost > 300 OR due <= coalesce(following, (SELECT max(ms) FROM l))),
    f AS (SELECT extraction_id, arg_min(status, i) AS status, arg_min(ended_ms, i) AS ended_ms FROM e GROUP BY 1)
    SELECT extraction_id, coalesce(status, 'IN_PROGRESS') AS status, ended_ms FROM (SELECT DISTINCT extraction_id FROM l) LEFT JOIN f USING (extraction_id)""")
def c09_stream(t):
    """The monitor as a stream over event time, stopped and started anew from its checkpoint twice."""
    kind = F.col("event_type")
    done = F.when(kind == "purchase", 2).when(kind.isin("view", "click"), 1).otherwise(0).cast("long")
    looks = t.events.select(F.col("user_id").alias("extraction_id"), F.col("ts").cast("timestamp").alias("at"), done.alias("done"), F.lit(2).cast("long").alias("total"), F.col("value").alias("cost"))
    return watch.watched(looks, 300.0)


_TRIES = r"[CASE WHEN doc_id % 5 = 0 THEN '(' ELSE 'zz+' END, CASE doc_id % 3 WHEN 0 THEN '[.!?] ' WHEN 1 THEN '\n\n' ELSE ', ' END, '\n', '[.!?]\s+']"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, 2 + doc_id % 40 AS expected, {_TRIES} AS tries FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, expected, k, CASE WHEN tries[k] <> '(' THEN len(list_filter(regexp_split_to_array(text, CASE WHEN tries[k] = '(' THEN 'x' ELSE tries[k] END), lambda c: regexp_matches(c, '\S'))) END AS n FROM d, range(1, 5) r(k)),
    g AS (SELECT doc_id, min(k) FILTER (n > 0 AND abs(n - expected) <= CASE WHEN expected > 5 THEN expected // 10 ELSE 0 END) AS attempt, arg_min(n, k) FILTER (n > 0 AND abs(n - expected) <= CASE WHEN expected > 5 THEN expected // 10 ELSE 0 END) AS chunks FROM a GROUP BY doc_id)
    SELECT doc_id, attempt, coalesce(chunks, 0) AS chunks, coalesce(attempt - 1, 4) AS failed FROM g""")
def b24_attempts(t):
    """Whole documents split by the expressions recorded for them, until one gives about as many parts as expected."""
    k, lit = F.col("doc_id"), F.lit
    tries = F.array(F.when(k % 5 == 0, lit("(")).otherwise(lit("zz+")), F.when(k % 3 == 0, lit("[.!?] ")).when(k % 3 == 1, lit("\\n\\n")).otherwise(lit(", ")), lit("\\n"), lit(r"[.!?]\s+"))
    got = t.documents.where("text is not null").select("doc_id", chunking.split_by_attempts()(F.col("text"), tries, lit(None).cast("string"), (k % 40 + 2).cast("long")).alias("x"))
    return got.select("doc_id", "x.attempt", F.coalesce(F.size("x.chunks"), lit(0)).alias("chunks"), F.size("x.errors").alias("failed"))


_NEEDLES = ("Ring", "D WID", "le", "%", "gear ECON", "no such thing")


@query(f"SELECT needle, p_partkey FROM part, (SELECT unnest({list(_NEEDLES)}) AS needle) WHERE contains(lower(p_name || ' ' || p_type), lower(needle))")
def a39_indexed_search(t):
    """Searches of names by an index of their trigrams: the same rows as reading them all, percent signs being letters."""
    named = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    index = search.TrigramIndex(named, "p_partkey", "name")
    return reduce(lambda a, b: a.unionByName(b), [index.search(n).select(F.lit(n).alias("needle"), "p_partkey") for n in _NEEDLES])


_WORDS = """SELECT url, lower(regexp_extract(html, '<h1>[^A-Za-z]*([A-Za-z]+)', 1)) AS word, list_transform(regexp_extract_all(html, '<li><a href="/([A-Za-z]+)"', 1), lambda x: lower(x)) AS menu, page_id FROM pages"""


@query(f"""WITH RECURSIVE p AS ({_WORDS}), l AS (SELECT url, '/' || unnest(menu) AS link FROM p UNION SELECT '/' || word, url FROM p WHERE word <> ''),
    r AS (SELECT url, 0 AS level FROM p WHERE menu = [] OR word LIKE 'a%' UNION SELECT l.link, level + 1 FROM r JOIN l USING (url) WHERE level < 8) SELECT url, min(level) AS level FROM r GROUP BY url""")
def c05_recorded_crawl(t):
    """A crawl of the recorded pages over their menus, eight steps far: a menu's word leads to the pages whose heading
    begins with it. It starts at the pages without a menu, or with an A."""
    word = F.lower(F.regexp_extract("html", "<h1>[^A-Za-z]*([A-Za-z]+)", 1))
    menu = F.transform(F.regexp_extract_all("html", F.lit('<li><a href="/([A-Za-z]+)"'), F.lit(1)), F.lower)
    p = written(t.pages.select("url", word.alias("word"), menu.alias("menu")), "pages")
    link = p.select("url", F.explode(F.transform("menu", lambda w: F.concat(F.lit("/"), w))).alias("link")).unionByName(p.where("word <> ''").select(F.concat(F.lit("/"), "word").alias("url"), F.col("url").alias("link"))).distinct()
    frontier = Frontier(t.spark)
    try:
        return written(frontier.crawl(p.where((F.size("menu") == 0) | F.col("word").startswith("a")).select("url"), link, crawl.MAX_DEPTH), "crawl")
    finally:
        frontier.drop()


@query("""SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey, coalesce(n, 0) AS recipes FROM nation JOIN customer ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def a25_institution_rows(t):
    """An institution's catalogues as rows with their places, however many it has: no row and no task holds them all."""
    catalogues = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "c_custkey", (-F.col("c_acctbal")).alias("order"))
    placed = ranks.placed(catalogues, "n_nationkey", ["order", "c_custkey"], "place")
    return rel.with_count(placed, t.orders, "c_custkey", "o_custkey", "recipes").select("n_nationkey", "place", "c_custkey", "recipes")


@query("""SELECT o_custkey, nth AS step, o_orderkey, l_partkey, CASE WHEN l_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey, l_linenumber) END AS page
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def a12_extraction_rows(t):
    """Every page of every step of every extraction, with its place in the step and the step's in the extraction; a step
    without pages is one row. Places are made range by range, so neither a long step nor a long extraction is one task."""
    steps = ranks.placed(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], "step")
    pages = ranks.placed(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber"), "o_orderkey", ["l_partkey", "l_linenumber"], "page")
    return steps.join(pages, "o_orderkey", "left").select("o_custkey", "step", "o_orderkey", "l_partkey", "page")
