from pyspark.sql import functions as F

from quarry.functions import recipes
from quarry.operators import retries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_pagination(spark):
    def error(pattern, kind="page_num", start=None, paginated=True, content="see /list here"):
        return one(spark, recipes.pagination_error(F.lit(paginated), F.lit(kind), F.lit(pattern), F.lit(content), F.lit(start).cast("double")))

    good = "https://x.edu/list?p={page_num}"
    assert error(good) is None and error(good, start=0) is None and error(None, paginated=None) is None
    assert error(good, kind="other") == "unknown pagination type"
    assert error("/list?p={page_num}") == "pattern is not a URL"
    assert error(good, kind="offset") == "pattern has no placeholder"
    assert error(good, content="nothing") == "path not found in the page"
    assert error(good, start=-1) == error(good, start=1.5) == "bad start page"


def test_setup_steps(spark):
    steps = [("click", "#a", None, None), ("click", " ", None, "empty selector"), ("wait", None, 600.0, None), ("wait", None, 0.0, "bad seconds"), ("wait", None, float("nan"), "bad seconds"), ("wait", None, None, "bad seconds"), ("hover", None, None, "unknown step"), (None, None, None, "unknown step")]
    got = spark.createDataFrame(steps, "kind string, selector string, seconds double, want string")
    assert got.where(~recipes.setup_error(F.col("kind"), F.col("selector"), F.col("seconds")).eqNullSafe(F.col("want"))).count() == 0


def test_preview(spark):
    page = '<title></title><meta name="og:title" content="T"><meta name="og:image" content=""><img alt="x" src="i.png">'
    shown = {k: one(spark, c) for k, c in recipes.preview(F.lit("https://h.edu/a/b"), F.lit(page)).items()}
    assert shown == {"title": "T", "description": None, "thumbnail": "https://h.edu/a/i.png"}


def test_retries(spark):
    calls = [(1, 1, "a", True, False), (1, 2, "b", False, True), (1, 3, "c", True, True), (1, 4, "d", True, True), (2, 1, "a", False, True), (3, 1, "a", True, False), (3, 2, "b", True, False), (3, 3, None, False, False), (3, 4, None, False, False), (3, 5, "e", True, True)]
    df = spark.createDataFrame(calls, "id long, at long, answer string, returned boolean, passed boolean")
    got = retries.settled(df, "id", "at", "answer", F.col("returned"), F.col("passed"))
    assert sorted(map(tuple, got.collect())) == [(1, "c", 3, True), (2, "a", 1, True), (3, "b", 4, False)]


def test_votes(spark):
    calls = [(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (1, 4, "x"), (1, 5, None), (1, 6, "x"), (2, 1, None)]
    df = spark.createDataFrame(calls, "id long, at long, answer string")
    assert sorted(map(tuple, retries.voted(df, "id", "at", "answer", 5, "none").collect())) == [(1, "y"), (2, "none")]


def test_display(spark):
    assert one(spark, recipes.title_case(F.lit("aB c  dE"))) == "Ab C  De"
    assert one(spark, recipes.concise_date(F.lit("2026-01-02 03:04:05").cast("timestamp"))) == "2026-01-02 03:04"
