from pyspark.sql import functions as F

from quarry.functions import html, robots, text
from quarry.operators import ranks, verification
from quarry.streaming import completion


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_domains(spark):
    assert one(spark, text.parse_domains(F.lit("north.quarry.test,\n http://south.quarry.test/x , north.quarry.test,"))) == ["north.quarry.test", "south.quarry.test"]
    for given, want in ((" http://www.QUARRY.test/a/b ", "quarry.test"), ("www.www.quarry.test", "www.quarry.test"), ("WWW.quarry.test", "www.quarry.test"), ("HTTP://quarry.test", "http:"), ("", "")):
        assert one(spark, text.normalize_domain(F.lit(given))) == want
    for given, good in (("a.b", True), ("-a.b", False), ("a", False), ("a..b", False), ("a b.c", False), ("a.-b", True), ("a.b.", False)):
        assert one(spark, text.valid_domain(F.lit(given))) is good


def test_page_urls(spark):
    p = F.lit("https://x.edu?page={page_num}")
    assert one(spark, text.page_urls(p, F.lit(3), F.lit(0))).urls[-1] == "https://x.edu?page=2"
    assert one(spark, text.page_urls(p, F.lit(2))).urls[0] == "https://x.edu?page=1"
    assert one(spark, text.page_urls(p, F.lit(0))).urls == []
    for bad in ("", "  ", "https://x.edu?page=1"):
        got = one(spark, text.page_urls(F.lit(bad), F.lit(3)))
        assert got.urls is None and got.error


def test_numbers_and_names(spark):
    assert one(spark, text.parse_number(F.lit(" 3.5 credits"))) == 3.5
    assert one(spark, text.parse_number(F.lit("three"))) is None
    assert one(spark, text.file_name(F.lit("  a/b  c!"))) == "a_b_c"
    assert one(spark, text.mask_proxy(F.lit("http://user:secret@host:80"))) == "user:******@host:80"


def test_inclusion(spark):
    assert one(spark, text.included(F.lit("See [Intro to X](/u) now"), F.lit("intro TO x")))
    assert one(spark, text.included(F.lit("page"), F.lit(" ")))


def test_robots(spark):
    got = robots.parse("User-agent: mole\nUser-agent: *\nDisallow: /pit/ # deep\nDisallow:\nDisallow: /*.ore$\nAllow: /pit/view/\nCrawl-delay: 5\nSitemap: s")
    assert len(got["rules"]) == 1 and got["rules"][0]["delay"] == 5 and got["sitemaps"] == ["s"]
    rule = robots.rule_for(got)
    lists = [F.array(*map(F.lit, rule[k])) for k in ("allow", "disallow")]
    for path, ok in (("/", True), ("/pit/x", False), ("/pit/view/y", True), ("/seam.ore", False), ("/seam.ores", True)):
        assert one(spark, text.robots_allows(F.lit(path), *lists)) is ok
    assert robots.parse("")["rules"] == []


def test_markdown():
    md, error = html.simplified("<html><head><title>t</title></head><body><h1>A</h1><div><p>x <a href='/u'>y</a></p></div><ul><li>1</li><li>2</li></ul><script>z</script></body></html>")
    assert error is None and md.startswith("A\n=") and "[y](/u)" in md and "*   1" in md and "z" not in md
    assert html.simplified("<p>x</p>", "#no") == (None, "ContentSelectorError")


def test_markdown_of_deep_pages():
    deep = "<div>" * 5000 + "<b>x</b> <a href='/u'>y</a>" + "</div>" * 5000
    assert html.simplified(deep) == ("**x** [y](/u)", None)
    assert html.simplified("<div>" * 5000 + "<p id='k'>z</p>", "div p#k") == ("z", None)
    assert html.simplified("<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>")[0] == "1.  a\n    *   b\n2.  c"


def test_markdown_of_a_page():
    page = """<html><head><title>t</title><link rel=x></head><body class="c"><script>no()</script><!-- no -->
      <div><div id="outer"><div>
        <h2 class="big">Ore &amp; <em>more</em></h2>
        <p>a_b *c* [d]  `e` <a href="/x(1)" class="l"> link </a>, <img src="/i.png"><b> bold </b>end.</p>
        <p>1. not a list</p><p># not a heading</p><p>- nor this</p><p>&gt; nor a quote</p>
      </div></div></div>
      <div></div><iframe src="x"></iframe><iframe src="y">in</iframe>
      <pre><code>if x:\n    a_b = 1\n</code></pre>
      <p>Use <code>a`b</code> and <code>c_d</code>.</p>
      <blockquote><p>one</p><p>two</p></blockquote><hr>
      <ol><li>first<ul><li>inner</li><li>last</li></ul></li><li><p>second</p></li></ol>
      <button number="2"> Page 2 </button><button number="...">more</button>
      <footer>no</footer></body></html>"""
    want = """Ore & _more_
------------

a\\_b \\*c\\* \\[d\\] \\`e\\` [link](/x\\(1\\)) ,  **bold** end.

1\\. not a list

\\# not a heading

\\- nor this

\\> nor a quote

in

    if x:
        a_b = 1
    

Use ``a`b`` and `c_d`.

> one
> 
> two

* * *

1.  first
    *   inner
    *   last
2.  second
    

[Page 2](/courses?page=2)"""
    assert html.simplified(page) == (want, None)
    # An open bold goes on in the paragraphs after it; a div that is left empty by others stays out of the text.
    assert html.simplified("<p><b>one<br><p>two</p><div><div></div></div><p><b>three</p>")[0] == "**one  \n**\n\n**two**\n\n****three****"
    assert html.simplified("<a href='/'></a><p> </p>x")[0] == "[](/)\n\nx"


def test_selectors():
    page = "<menu class='x top'>menu</menu><div role=main lang='en-GB'><p class='a b'>one</p><p id=k>two <em>e</em></p><hr><p>three</p></div><section><p>four</p></section>"
    for selector, want in (
        ("[role=main] p", "one"),
        ("div>p", "one"),
        ("div > p + p", "two _e_"),
        ("hr ~ p", "three"),
        ("hr+p", "three"),
        ("section > em, section > p", "four"),
        ("p:not(.a):not(#k)", "three"),
        ("p:nth-child(2)", "two _e_"),
        ("div p:last-child", "three"),
        ("[lang|=en] em", "_e_"),
        ("[class~=b]", "one"),
        ("[class$='b'], [class^='x']", "menu"),
        ("[CLASS*='op']", "menu"),
        ("* > em", "_e_"),
        ("em:only-child", "_e_"),
        ("  #k  ", "two _e_"),
    ):
        assert html.simplified(page, selector) == (want, None), selector
    for selector in ("p[", "p:hover", "a,,b", "> p", "p >", "h9", "section + section", "hr + hr", "#k p", "div.x", "p:nth-child(9)"):
        assert html.simplified(page, selector) == (None, "ContentSelectorError"), selector


def test_robots_as_they_are_read(spark):
    two = "User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\n\nUser-agent: mole\nAllow: /\n"
    assert robots.rule_for(robots.parse(two))["disallow"] == ["/one"]  # the first, as it is named exactly
    assert robots.rule_for(robots.parse(two), "vole")["disallow"] == ["/two"]  # the last, for want of one's own
    assert robots.rule_for(robots.parse(two), "Mole")["disallow"] == ["/two"]
    assert robots.parse("User-agent: *\nDisallow: /a\n\nUser-agent: *")["rules"][0]["disallow"] == ["/a"] and len(robots.parse("User-agent: *\nDisallow: /a\n\nUser-agent: *")["rules"]) == 1
    for given, delay in (("5s", 5), (" .5", 0.5), ("1e1x", 10), ("nan", None), ("inf", None), ("1e999", None), ("-2", -2), ("x", None)):
        rules = robots.parse(f"User-agent: *\r\nAllow: /x\x0by\r\nCrawl-delay: {given}")["rules"]
        assert (rules[0]["delay"], rules[0]["allow"]) == (delay, ["/x\x0by"])
    assert robots.parse("Sitemap: a\nUser-agent: *\nSitemap: b\nAllow: /")["rules"][0]["sitemaps"] == ["b"]


def test_robots_of_many_hosts(spark):
    from quarry.operators import robots_table

    files = {"a.test": "User-agent: *\nDisallow: /*.ore$\nDisallow: /pit/\nAllow: /pit/view\nCrawl-delay: 2", "b.test": "User-agent: *\nDisallow: /a(", "c.test": "User-agent: *\nAllow: /x", "d.test": "User-agent: *\nDisallow: *z|/y\nDisallow: /++", "e.test": "User-agent: *\nDisallow: /q?r$", "f.test": None}
    pages = [("http://A.test/pit/1", False, 3000), ("http://a.test:80/pit/view/2", True, 2000), ("http://a.test/x.ore", False, 3000), ("http://a.test/xore?.ore", True, 2000), ("http://a.test", True, 2000), ("http://b.test/", None, 3000), ("http://c.test/y", True, 3000), ("http://d.test/", None, 3000), ("http://e.test/r", False, 3000), ("http://e.test/qr", False, 3000), ("http://e.test/q?r", True, 3000), ("http://f.test/", True, 3000), ("http://g.test/", True, 3000), ("no url", True, 3000), (None, True, 3000)]
    rules = robots_table.rules_by_host(spark.createDataFrame(list(files.items()), "host string, body string"))
    got = robots_table.judged(spark.createDataFrame([(u,) for u, _, _ in pages], "url string"), rules).collect()
    assert {(r.url, r.allowed, r.interval_ms) for r in got} == set(pages) and len(got) == len(pages)
    assert {r.host for r in got if r.error} == {"b.test", "d.test"}


def test_inclusion_of_items(spark):
    from quarry.functions import text as tx
    from quarry.operators.verification import inclusion

    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(rng.randrange(1, 12))).capitalize() + rng.choice(".!?") for _ in range(60)]
    docs = [(i, " ".join(rng.choice(passage) for _ in range(rng.randrange(12)))) for i in range(80)] + [(100, None), (101, ""), (102, "Dr. No. 5 ran. He won!\nLine two"), (103, "x" * 2_500_000 + " ".join(word() for _ in range(500_000)) + " The very end of it all.")]
    items = [(i, " ".join(rng.choice(passage) for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(200, ""), (201, None), (202, "a"), (203, "He won! Dr. No. 5 ran."), (204, "very end of it all"), (205, "?!"), (206, "ran. He"), (207, "xxxxxxxxxxxxxxxxxxxxxxxxx"), (208, passage[0][:-1])]
    got = {(r.doc_id, r.item_id): (r.full, r.sentences) for r in inclusion(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    pre = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    cut = dict(spark.createDataFrame([*docs, *((-i - 1, t) for i, t in items)], "i long, text string").select("i", tx.sentences(F.col("text"))).collect())
    want = {}
    for d, p in docs:
        for i, q in items:
            if p is not None and q is not None:
                flags = (pre(q) in pre(p), set(cut[-i - 1]) <= set(cut[d]))
                if any(flags):
                    want[d, i] = flags
    assert got == want and {f for f in want.values()} == {(True, True), (True, False), (False, True)}
    assert cut[102] == ["Dr. No. 5 ran.", "He won!", "Line two"] and got[102, 203] == (False, True) and got[103, 204] == (True, False)


def test_ranks(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{i % 20}", i % 97, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    got = {(r.k, r.a, r.b): r.n for r in ranks.placed(df, "k", ["a", "b"], "n", ranges=8).collect()}
    by = {}
    for k, a, b in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1:]):
        by[k] = by.get(k, 0) + 1
        assert got[k, a, b] == by[k]
    assert len(got) == 2000 and all(got[r] is None for r in rows if r[0] is None)
    for part in (0, 0.03, 0.5, 1):
        first = ranks.first_rows(df, [F.col("a"), F.col("b")], part).collect()
        assert sorted((r.a, r.b) for r in first) == sorted(r[1:] for r in rows)[: -int(-2000 * part // 1)]


def test_included_items(spark):
    docs = spark.createDataFrame([(1, "a" * 40 + "needle" + "b" * 40), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "aaaaneedlebbbbbbbbbb"), (2, "need"), (3, ""), (4, None), (5, "a" * 39 + "c"), (6, "short")], "item_id long, text string")
    got = sorted(map(tuple, verification.included_items(docs, items).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (2, 3), (4, 3), (4, 6)]


def test_completion():
    assert completion.decide("IN_PROGRESS", 60, 50, False, False, 0) == "CANCELLED"
    assert completion.decide("IN_PROGRESS", 1, 50, True, True, 300) == "COMPLETE"
    assert completion.decide("IN_PROGRESS", 1, 50, True, False, 300) == "IN_PROGRESS"
    assert completion.decide("IN_PROGRESS", 1, 50, True, False, 4 * 3600) == "STALE"


def test_completion_stream(spark, tmp_path):
    rows = [(1, 0.0, 1, 2, 1.0), (1, 400.0, 2, 2, 1.0), (1, 800.0, 2, 2, 1.0), (2, 0.0, 0, 2, 99.0)]
    schema = "extraction_id long, at double, done long, total long, cost double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = completion.monitor(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("looks").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {r.extraction_id: r.status for r in spark.table("looks").collect()} == {1: "COMPLETE", 2: "CANCELLED"}


def test_resolve(spark):
    from quarry.functions import urls

    base = F.lit("https://h.edu/a/b/c.html?q=1#f")
    for link, want in (("d", "https://h.edu/a/b/d"), ("../d/./e?x#y", "https://h.edu/a/d/e?x#y"), ("../../../z", "https://h.edu/z"), ("?p=2", "https://h.edu/a/b/c.html?p=2"), ("#g", "https://h.edu/a/b/c.html?q=1#g"), ("//o.org/x", "https://o.org/x"), ("mailto:a", "mailto:a"), ("/r/..", "https://h.edu/"), ("..", "https://h.edu/a/")):
        assert one(spark, urls.resolve(base, F.lit(link))) == want
    assert one(spark, urls.resolve(F.lit("none"), F.lit("x"))) is None


def test_csv_round_trip(spark, tmp_path):
    from quarry.sources import csv_sink

    rows = [(1, 'a "quoted", cell'), (2, "two\nlines"), (3, None)]
    csv_sink.write(spark.createDataFrame(rows, "id long, name string"), str(tmp_path / "x"), 1)
    assert sorted(map(tuple, csv_sink.read(spark, str(tmp_path / "x"), "id long, name string").collect())) == rows
