"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quarry.plans import answered, catalogue, exports, frontier, lifecycle, nested, recipes, verified, watched  # noqa: F401  (the others add their queries to the catalogue)

DATA = "/root/testdata/sf0.001"


def rows(df):
    def plain(v):
        return "" if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.astype(object)) == rows(want.astype(object))


def test_error_pages_and_datasets_are_whole(spark):
    """No error page is lost after the hundredth, no parent from 50 on, and each parent's total stands beside its page."""
    data = "/root/testdata/sf0.01"
    orders = pd.read_parquet(f"{data}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderstatus"])
    errors = orders[orders.o_orderstatus == "P"]
    got = catalogue.QUERIES["a17_all_error_pages"](spark, data).toPandas()
    assert len(errors) > 100 and sorted(got.o_orderkey) == sorted(errors.o_orderkey)
    got = catalogue.QUERIES["a41_datasets_pages"](spark, data).toPandas()
    sizes = orders.groupby("o_custkey").size()
    assert max(sizes.index) > 50 and max(sizes) > 20
    assert got.groupby("o_custkey").total.first().to_dict() == sizes.to_dict()
    assert got.groupby("o_custkey").size().to_dict() == sizes.clip(upper=20).to_dict()


def on_pages(spark, folder, name, html):
    """What the query and its SQL make of pages that a test made."""
    pd.DataFrame({"page_id": range(len(html)), "url": "https://x.edu/", "html": html}).to_parquet(f"{folder}/pages.parquet")
    got = catalogue.QUERIES[name](spark, str(folder)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    return rows(got.astype(object)), rows(c.execute(catalogue.ORACLE_SQL[name]).df().astype(object))


CUT = [f'<html><body><ul><li><a href="/a">x</a></li></ul><article><h1>{h}</h1><p>{p}</p></article></body></html>' for h, p in (("A&amp;&amp", "b"), ("C &quot;1&quo", "d &lt; e &lt"), ("&nbsp;E &amp;lt; f", "&eacute; &#65; &g"), ("G &amp;amp; h", "i & j&amp;"))]


def test_cut_entities_of_a_heading(spark, tmp_path):
    got, want = on_pages(spark, tmp_path, "b03_markdown", CUT)
    assert got == want


def test_cut_entities_of_a_page(spark, tmp_path):
    got, want = on_pages(spark, tmp_path, "b03_page_markdown", CUT)
    assert got == want


def test_totals_of_items_without_broadcast(spark, tmp_path):
    """Items on line 1, without a line or an order, orders that are missing or there twice; orders aren't sent to all tasks."""
    pd.DataFrame({"l_partkey": [1, 1, 1, 2, 2, 2, None], "l_orderkey": [5, 5, 6, 7, 5, None, 6], "l_linenumber": [1, 2, 2, 3, None, 2, 1]}).astype("Int64").to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": [5, 6, 6, None]}).astype("Int64").to_parquet(tmp_path / "orders.parquet")
    got = catalogue.QUERIES["a07_items_total"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert rows(got.toPandas().astype(object)) == rows(c.execute(catalogue.ORACLE_SQL["a07_items_total"]).df().astype(object))
    assert "BroadcastExchange" not in got._jdf.queryExecution().toString()
