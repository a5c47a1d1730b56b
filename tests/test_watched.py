"""Ancestors, similar vectors, matched multisets, slots and the completion stream against plain versions of themselves."""

import datetime as dt
import random
import time

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import forest, matching, similarity
from quarry.plans import catalogue, crawl, watched  # noqa: F401  (adds its queries)
from quarry.streaming import watch

DATA = "/root/testdata/sf0.001"


def test_ancestors(spark):
    rng = random.Random(1)
    parent = {i: i - 1 for i in range(1, 10_000)} | {0: None}  # a chain
    parent |= {20_000 + i: 20_000 + rng.randrange(i) if i else None for i in range(3000)}  # a random tree
    parent |= {30_000 + i: 0 for i in range(2000)} | {40_000: 99_999_999}  # many children of one parent; a parent that is not there
    parent |= {50_000: 50_001, 50_001: 50_002, 50_002: 50_000, 50_003: 50_000, 50_004: 50_003, 50_005: 50_005}  # circles, and ways into them
    want = {}
    for i in parent:
        way, at = [i], parent[i]
        while at in parent and at is not None and len(way) <= len(parent) and at not in (50_000, 50_005):
            way.append(at)
            at = parent[at]
        cyclic = 50_000 <= i
        want[i] = (None, None, True) if cyclic else (len(way), way[-1], False)
    got = forest.ancestors(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()
    assert {r["id"]: (r["depth"], r["root"], r["cyclic"]) for r in got} == want and len(got) == len(want)
    assert forest.ancestors(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_similar_vectors_are_found(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.3, 0.5, 0.6, 0.75)])
    vectors = np.concatenate([base, near, [base[0]] * 200, [np.zeros(32)] * 3])
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    firsts = {i: int(np.flatnonzero((vectors == vectors[i]).all(axis=1))[0]) for i in range(len(vectors))}
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    cos = unit @ unit.T
    own = sorted(set(firsts.values()))
    exact = {(a, b) for n, a in enumerate(own) for b in own[n + 1 :] if cos[a, b] >= 0.85}
    only = rows.where(F.col("id").isin(own))
    for recall in (0.9, 0.999):
        got = similarity.similar_pairs(only, 0.85, recall).collect()
        pairs = {(r["a"], r["b"]) for r in got}
        assert len(pairs) == len(got) and pairs <= exact and len(pairs) >= recall * len(exact)
        assert all(abs(r["cosine"] - cos[r["a"], r["b"]]) < 1e-9 for r in got)
    assert len(exact) > 300
    linked = {r["id"]: r for r in similarity.linked(rows, 0.85, 0.9999).collect()}
    assert {i: r["class"] for i, r in linked.items()} == firsts
    assert all(linked[i]["links"] == sum(firsts[i] in p for p in exact) for i in firsts)


def test_no_similar_vector_is_missed(spark, monkeypatch):
    """Vectors of quarters, many pairs of which are exactly as similar as the threshold; groups and blocks of a few rows."""
    rng = np.random.default_rng(5)
    made = []
    for _ in range(300):
        # 20 numbers that aren't 0, of which 17 are the next one's too: a cosine of 17/20.
        at, first = rng.permutation(24), np.zeros(24)
        first[at[:20]] = rng.choice([-0.25, 0.25], 20)
        second = first.copy()
        second[at[:3]], second[at[20:23]] = 0, 0.25
        made += [first, second, np.where(np.arange(24) == at[5], 0, first), np.where(rng.random(24) < 0.2, 0, second)]
    vectors = np.unique(made, axis=0)
    whole = np.rint(vectors * 4).astype(int)
    dot, squares = whole @ whole.T, (whole**2).sum(1)
    # cosine >= 17/20, in whole numbers
    links = (dot > 0) & (400 * dot**2 >= 289 * squares[:, None] * squares) & ~np.eye(len(whole), dtype=bool)
    ties = (dot > 0) & (400 * dot**2 == 289 * squares[:, None] * squares)
    assert ties.sum() > 20 and links.sum() > 500
    monkeypatch.setattr(similarity, "GROUP_NUMBERS", 24 * 150)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    got = {r["id"]: r for r in similarity.linked(rows, 0.85).collect()}
    assert {i: got[i]["links"] for i in got} == {i: int(links[i].sum()) for i in range(len(whole))}
    cos = dot / np.sqrt(np.maximum(squares[:, None] * squares, 1))
    assert all(abs(got[i]["best"] - cos[i][links[i]].max()) < 1e-12 if links[i].any() else got[i]["best"] is None for i in got)
    assert similarity.linked(rows.limit(0), 0.85).count() == 0


def test_counts_of_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 8))
    cos = (unit := x / np.linalg.norm(x, axis=1)[:, None]) @ unit.T
    links = (cos >= 0.5) & ~np.eye(100, dtype=bool)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    (a, b), (p, q) = similarity._counted(x, x, 0.5, True)
    assert (a + b == links.sum(1)).all() and np.allclose(np.maximum(p, q)[a + b > 0], np.where(links, cos, -2).max(1)[a + b > 0])
    (a, b), _ = similarity._counted(x[:70], x[70:], 0.5, False)
    assert (a == links[:70, 70:].sum(1)).all() and (b == links[:70, 70:].sum(0)).all()


def test_pairs_of_all_blocks_take_little_more_than_their_products():
    """Time of the processor, all threads added up. The bare products are in doubles, which the counts aren't."""
    x = np.random.default_rng(7).normal(size=(6000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    took = {"counts": [], "products": []}
    for _ in range(3):
        began = time.process_time()
        similarity._counted(x, x, 0.85, True)
        took["counts"].append(time.process_time() - began)
        began = time.process_time()
        for i in range(0, 6000, 500):
            for j in range(i, 6000, 500):
                unit[i : i + 500] @ unit[j : j + 500].T
        took["products"].append(time.process_time() - began)
    assert min(took["counts"]) < 4 * min(took["products"])


def test_heads_are_bounds():
    rng = np.random.default_rng(8)
    for scale in (np.ones(64), 0.8 ** np.arange(64)):
        x = [rng.normal(size=(700, 64)) * scale for _ in range(2)]
        turned = similarity._turned(x, [similarity._sums(v, v) for v in x])
        cos = (x[0] / np.linalg.norm(x[0], axis=1)[:, None]) @ (x[1] / np.linalg.norm(x[1], axis=1)[:, None]).T
        assert np.abs(turned[0] @ turned[1].T - cos).max() < 72 * 2.0**-24
        heads = similarity._heads(turned, np.float32(0.85))
        assert heads[0].shape[1] <= 37 and (heads[0] @ heads[1].T > cos - 72 * 2.0**-24).all()


def test_near_the_threshold_the_cosine_decides(monkeypatch):
    """Pairs that differ from the threshold by less than single precision tells, and rows whose best two others do."""
    monkeypatch.setattr(similarity, "PENDING", 100)
    monkeypatch.setattr(similarity, "EXACT", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1)[:, None] * x
    other /= np.linalg.norm(other, axis=1)[:, None]
    off = np.concatenate([s * 10.0 ** -rng.uniform(4, 12, 100) for s in (1, -1)])
    angle = np.arccos(0.85 + off)[:, None]
    y = np.concatenate([x * np.cos(angle) + other * np.sin(angle), x * np.cos(0.3) + other * np.sin(0.3), x * np.cos(0.3 + np.abs(off)[:, None]) + other * np.sin(0.3 + np.abs(off)[:, None])])
    cos = np.array([similarity._cosines(np.repeat(v[None], len(y), 0), y) for v in x])
    for rows in (1, 1000):
        monkeypatch.setattr(similarity, "TURNED", rows)
        (a, b), (p, q) = similarity._counted(x, y, 0.85, False)
        assert (a == (cos >= 0.85).sum(1)).all() and (b == (cos >= 0.85).sum(0)).all()
        assert (p == cos.max(1)).all() and (q[b > 0] == cos.max(0)[b > 0]).all()
    assert (cos.diagonal()[:100] >= 0.85).all() and (cos.diagonal()[100:] < 0.85).all()


def test_numbers_that_are_not_finite_leave_other_rows_alone(spark):
    rows = [(1, [1.0, 0.1, 0.0]), (2, [1.0, 0.2, 0.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 1.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, None), (7, [0.0, 0.0, 1.0]), (8, [1.0, 0.1, 0.0])]
    for kind in ("float", "double"):
        got = {r["id"]: r for r in similarity.linked(spark.createDataFrame(rows, f"id long, vector array<{kind}>"), 0.85).collect()}
        assert {i: (r["class"], r["links"]) for i, r in got.items()} == {1: (1, 1), 2: (2, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (1, 1)}
        assert all(abs(got[i]["best"] - 1.02 / (1.01 * 1.04) ** 0.5) < 1e-7 for i in (1, 2, 8)) and all(got[i]["best"] is None for i in (3, 4, 5, 6, 7))


def plain_match(expected, actual, fits):
    """expected, actual: lists of (place, row). The greedy walk over classes of equal rows."""
    def classes(rows):
        out = {}
        for place, row in sorted(rows):
            out.setdefault(row, [place, 0])[1] += 1
        return sorted([place, n, row] for row, (place, n) in out.items())

    e, a, out = classes(expected), classes(actual), []
    for one in e:
        for other in a:
            n = min(one[1], other[1]) if fits(one[2], other[2]) else 0
            if n:
                out.append((one[0], other[0], n))
                one[1], other[1] = one[1] - n, other[1] - n
    return out + [(p, None, n) for p, n, _ in e if n] + [(None, p, n) for p, n, _ in a if n]


def test_multisets_are_matched_greedily(spark):
    rng = random.Random(8)
    words = ["ore", "ores", "oar", "pit", "pits", "spit", None, ""]
    side = lambda n, at: [(rng.choice(["g", "h", "hot", "hot", None]), at + i, rng.choice(["x", "y", None]), rng.choice(words), rng.choice([1.0, 1.05, 1.2, 9.0, None])) for i in range(n)]
    expected, actual = side(250, 0), side(260, 1000)
    schema = "g string, place long, kind string, name string, amount double"

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def fits(a, b):
        (k1, n1, m1), (k2, n2, m2) = a, b
        longest = max(len(n1 or ""), len(n2 or ""))
        names = n1 == n2 if n1 is None or n2 is None or not longest else (longest - edit(n1, n2)) / longest >= 0.6
        amounts = m1 == m2 if m1 is None or m2 is None else abs(m1 - m2) <= 0.1 * max(m1, m2)
        return k1 == k2 and names and amounts

    matchers = {"kind": matching.same, "name": matching.alike(0.6), "amount": matching.near(0.1)}
    for block in ([], ["kind"]):
        found = matching.matched(spark.createDataFrame(expected, schema), spark.createDataFrame(actual, schema), ["g"], matchers, block).collect()
        got = {(r.g, r.expected, r.actual, r.n) for r in found}
        want = {(g, *x) for g in {r[0] for r in expected + actual} for x in plain_match(*([(r[1], r[2:]) for r in rows if r[0] == g] for rows in (expected, actual)), fits)}
        assert got == want and len(found) == len(got)
    assert {x is None for _, x, _, _ in got} == {True, False}
    vectors = matching.cosine(0.9)(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.1)))
    assert spark.range(1).select(vectors).first()[0] is True


def test_assignments_of_orders(spark):
    import pandas as pd

    o = pd.read_parquet(f"{DATA}/orders.parquet")
    got = {(r.o_custkey, r.expected, r.actual, r.n) for r in catalogue.QUERIES["b49_assignments"](spark, DATA).collect()}
    # Halves are rounded away from zero there.
    o["total"] = (o.o_totalprice / 1e4 + 0.5).apply(np.floor) * 1e4
    o["month"] = pd.to_datetime(o.o_orderdate).dt.strftime("%Y-%m")
    row = lambda r: (r.o_orderpriority, r.month, r.total)
    fits = lambda a, b: a[0] == b[0] and (7 - sum(x != y for x, y in zip(a[1], b[1], strict=True)) >= 4.9 or _edit(a[1], b[1])) and abs(a[2] - b[2]) <= 0.25 * max(a[2], b[2])

    def _edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return (7 - row[-1]) / 7 >= 0.7

    want = set()
    for c, rows in o.groupby("o_custkey"):
        sides = ([(r.o_orderkey, row(r)) for r in rows[rows.o_orderstatus == s].itertuples()] for s in ("O", "F"))
        want |= {(c, *x) for x in plain_match(*sides, fits)}
    assert got == want


def test_slots_of_batches(spark):
    pages = [(f"h{i % 3}" if i % 7 else None, i) for i in range(60)]
    schema = "host string, page_id long"
    whole = {(r.host, r.page_id): r.start_ms for r in crawl.slots(spark.createDataFrame(pages, schema), 3000).where("host is not null").collect()}
    free, got = spark.createDataFrame([], "host string, free_ms long"), {}
    for part in (pages[:10], pages[10:45], pages[45:]):
        slots, free = crawl.slots_of_batch(spark.createDataFrame(part, schema), free, 3000)
        got |= {(r.host, r.page_id): r.start_ms for r in slots.collect()}
    assert got == whole
    # Later, the hosts' times have passed: nobody waits, and a host that is not met is forgotten.
    slots, free = crawl.slots_of_batch(spark.createDataFrame([("h1", 99), ("h1", 98)], schema), free, 3000, now_ms=10**6)
    assert [r.start_ms for r in slots.orderBy("page_id").collect()] == [10**6, 10**6 + 3000]
    assert [tuple(r) for r in free.collect()] == [("h1", 10**6 + 6000)]


def test_the_stream_goes_on_where_it_stopped(spark, tmp_path):
    at = lambda minutes: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minutes)
    parts = [
        # 1 settles within the first part; 2 goes over budget; 3 is seen once; 4 changes on; 5 ends although nobody looks.
        [(1, at(0), 1, 2, 1.0), (1, at(3), 2, 2, 1.0), (1, at(9), 0, 2, 1.0), (2, at(1), 0, 2, 99.0), (3, at(5), 0, 2, 1.0), (4, at(10), 2, 2, 1.0), (5, at(2), 2, 2, 1.0)],
        [(4, at(14), 1, 2, 1.0), (2, at(15), 2, 2, 1.0), (6, at(200), 0, 1, 1.0)],
        [(4, at(254), 1, 2, 1.0), (7, at(255), 1, 1, 1.0)],
    ]
    source, folder = str(tmp_path / "looks"), str(tmp_path / "run")
    seen = []
    for rows in parts:
        spark.createDataFrame(rows, watch.LOOKS).coalesce(1).write.mode("append").parquet(source)
        watch.run_available(spark, source, folder)
        seen.append({r.extraction_id: (r.status, r.ended_ms) for r in spark.read.schema(watch.ENDS).parquet(f"{folder}/ends").collect()})
    ms = lambda minutes: int(at(minutes).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert seen[0] == {1: ("COMPLETE", ms(8)), 2: ("CANCELLED", ms(1)), 5: ("COMPLETE", ms(7))}
    assert seen[1] == seen[0]
    assert seen[2] == seen[0] | {3: ("STALE", ms(245)), 4: ("STALE", ms(254))}
    assert spark.read.parquet(f"{folder}/ends").count() == len(seen[2])
