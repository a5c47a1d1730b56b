"""Trigram search, splitting by attempts and the visited table against plain versions of themselves."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking, text
from quarry.operators import ranks
from quarry.operators.frontier import Frontier
from quarry.operators.search import TrigramIndex


def test_search_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcAB cé%_") for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", None, "ab", "ABC", "straße", "İstanbul", "abc" * 5000]
    table = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(4)
    index = TrigramIndex(table, "id", "name", f"{tmp_path}/index")
    for needle in ("abc", "ABCA", "b", "", "%", "a_b%", "éé", "bca%b", "straSSe", "STRAßE", "nowhere", "cabcabcab"):
        want = {i for i, n in enumerate(names) if n is not None and needle.lower() in n.lower()}
        assert {r["id"] for r in index.search(needle).collect()} == want, needle
    # Made once: another index over the folder takes what is there.
    assert TrigramIndex(table.limit(0), "id", "name", f"{tmp_path}/index").postings().count() == index.postings().count()
    # A search reads the files and parts whose grams it needs.
    plan = index.search("cabcabcab")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    gram = index.postings().groupBy(F.input_file_name()).agg(F.min("gram").alias("a"), F.max("gram").alias("b")).collect()
    assert sum(r["a"] <= "cab" <= r["b"] for r in gram) < len(gram)


def test_splitting_by_attempts(spark):
    assert chunking.plain("See [Intro](/x) to ![A](b) É1") == spark.range(1).select(text.preprocess(F.lit("See [Intro](/x) to ![A](b) É1"))).first()[0]
    page = "menu\n## One\na\n\n## Two\nb\n## Three\nc"
    for tries, title, expected, want in (
        (["("], "One", 3, (None, None, 1)),
        (["(", r"(?=## )", "\n"], "ONE", 3, (2, ["## One\na\n\n", "## Two\nb\n", "## Three\nc"], 1)),
        (["## "], None, 4, (1, ["menu\n", "One\na\n\n", "Two\nb\n", "Three\nc"], 0)),
        (["(## )"], "menu", 7, (1, ["menu\n", "## ", "One\na\n\n", "## ", "Two\nb\n", "## ", "Three\nc"], 0)),  # a group's text is a part, too; seven may not be six
        (["x"] * 10 + ["## "], "One", 3, (None, None, 10)),  # the eleventh is not tried
        (["## "], "Four", 3, (None, None, 1)),
        (["## "], "Four", 0, (1, [], 0)),
        ([], "One", 3, (None, None, 0)),
        (None, "One", 3, (None, None, 0)),
        (["## "], "One", None, (1, ["One\na\n\n", "Two\nb\n", "Three\nc"], 0)),
    ):
        got = chunking.attempted(page, tries, title, expected)
        assert (got["attempt"], got["chunks"], len(got["errors"])) == want
    assert [chunking.tolerance(n) for n in (1, 5, 6, 10, 19, 20, 100)] == [0, 0, 0, 1, 1, 2, 10]
    assert chunking.attempted(None, ["a"], None, 1)["attempt"] is None
    rows = spark.createDataFrame([(page, ["(", "## "], "one", 3), (None, None, None, None)], "c string, t array<string>, f string, n long")
    got = rows.select(chunking.split_by_attempts()("c", "t", "f", "n").alias("x")).select("x.*").collect()
    assert [(r.attempt, len(r.chunks or []), len(r.errors)) for r in got] == [(2, 3, 1), (None, 0, 0)]


@pytest.fixture
def frontier(spark):
    f = Frontier(spark, f"visited_{uuid.uuid4().hex}", buckets=3)
    yield f
    f.drop()


def test_a_crawl_reaches_what_a_plain_one_does(spark, frontier):
    rng = random.Random(9)
    links = [(f"u{rng.randrange(200)}", f"u{rng.randrange(200)}") for _ in range(260)] + [("u1", "u1"), ("u2", "u1"), ("u3", None)] * 2
    links += [("hub", f"v{i}") for i in range(300)] + [("u0", "hub")]
    seeds = ["u0", "u1", "u1", None]
    level, now, want = 0, {"u0", "u1"}, {}
    while now and level <= 8:
        want |= dict.fromkeys(now, level)
        now, level = {b for a, b in links if a in now and b is not None} - set(want), level + 1
    given = spark.createDataFrame(links, "url string, link string")
    got = frontier.crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), given, 8)
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    # A level that is added again is what it was; a crawl by the same name goes on with its table.
    again = Frontier(spark, frontier.name)
    before = again.visited().count()
    assert again.add(spark.createDataFrame([(u,) for u, n in want.items() if n <= 2], "url string"), 2) == sum(n == 2 for n in want.values())
    assert again.visited().count() == before
    plan = again.visited().select("digest", "url").join(spark.range(5).select(F.col("id").alias("digest")).hint("merge"), "digest", "left_semi")._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 3 out of 3" in plan


def test_numbers_over_a_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    assert [tuple(r) for r in ranks.numbered(df, ["a"], "n").orderBy("n").select("a", "n").collect()] == [(i, i + 1) for i in range(1000)]
    assert ranks.numbered(df.limit(0), ["a"], "n").count() == 0
