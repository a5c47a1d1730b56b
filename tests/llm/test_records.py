"""Token files, conversations and hard negatives against plain versions of themselves."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import conversations, hard_negatives, ngram_join, queries, token_files

SF = "/root/testdata/sf0.001"
WORDS = queries.vocabulary("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORDS)


def plain_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


# --- token files


def test_token_files_hold_every_document(spark, tmp_path):
    rng = random.Random(3)
    texts = ["", None, "  ", "one", "Élan <|endoftext|> don't 漢字 \U0001f600", "word " * 9000] + [" ".join(rng.choice(["alpha", "Beta", "gamma7", "δ"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = [(i * 3 % 157 if i else None, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, ids string, n_tokens int, part int").repartition(5)
    folder = f"file://{tmp_path}/files"
    files = token_files.write(docs, WORDS, folder, width=16, batch=4, file_sequences=20, part_bytes=2000)
    assert files.count() > 8  # ranges that were cut into several files among them
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len((r[1] or "").encode()))):
        ids = plain_ids(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(files, folder).orderBy("start").collect()]
    assert got == want

    fs, n_sequences = pa.fs.LocalFileSystem(), 0
    by_id = {i: plain_ids(t) for i, t in rows if i not in (5, None)}
    for r in files.orderBy("part", "file").collect():
        f = token_files.TokenFile(fs, f"{tmp_path}/files/{r['name']}")
        everything = [f.sequence(i) for i in range(r["n_sequences"])]
        n_sequences += len(everything)
        with pytest.raises(IndexError):
            f.sequence(r["n_sequences"])
        assert all(len(a) == len(m) == 16 for a, m in everything) and sum(m.true_count for _, m in everything) == r["n_tokens"]
        assert all(m.true_count == 16 for _, m in everything[:-1]) and not any(a[~m.to_numpy(zero_copy_only=False)].any() for a, m in everything)
        # Views of the mapped file: their bytes lie inside it.
        f.source.seek(0)
        mapped = f.source.read_buffer()
        for a, m in everything:
            for place in (a.ctypes.data, m.buffers()[1].address):
                assert mapped.address <= place < mapped.address + mapped.size
            assert not a.flags.owndata
        ids = np.concatenate([a for a, _ in everything])
        for b in f.docs():
            for doc_id, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if doc_id in by_id:
                    assert ids[at : at + n].tolist() == by_id[doc_id]
        with pa.ipc.open_stream(f"{tmp_path}/files/{r['name']}") as stream:  # any reader of Arrow streams can read them
            assert stream.read_all().num_rows == r["n_sequences"]
    assert n_sequences == files.agg(F.sum("n_sequences")).first()[0]


def test_token_files_of_an_empty_table_and_of_large_vocabularies(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(spark, none, WORDS).count() == 0
    one = token_files.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), WORDS, f"file://{tmp_path}", end_id=70_000)
    f = token_files.TokenFile(pa.fs.LocalFileSystem(), f"{tmp_path}/{one.first()['name']}")
    assert f.sequence(0)[0].dtype == np.uint32 and f.sequence(0)[0][1] == 70_000


def test_token_files_query(spark):
    rows = {r["doc_id"]: r for r in queries.op11_token_files(spark, SF).collect()}
    start = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = plain_ids(r["text"])
        got = rows.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


# --- sketches of the n-gram join


def test_sketches_differ_in_no_more_bits_than_sets_do_in_shingles():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 200, 3000):
        for kept in (0, 0.5, 0.9, 1):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < kept], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
            bits = sum(int(x).bit_count() for x in (ngram_join.sketched(a) ^ ngram_join.sketched(b)).view(np.uint64))
            apart = len(np.setxor1d(a, b))
            assert bits <= apart and (apart - bits) % 2 == 0 and (apart > 40 or bits >= apart - 6)


# --- conversations


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def well_formed(initials):
    rest = initials.removeprefix("s")
    return not initials or (rest and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def plain_repair(rows):
    """The cheapest and least audit by trying all edits, and what it leaves."""
    wrong, best = faults(rows), None
    choices = []
    for (role, text), f in zip(rows, wrong, strict=True):
        own = [(2, "D", None)]
        if f not in ("blank", "duplicate"):
            more = 5 if f == "truncated" else 0
            own += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        choices.append(own)
    for picked in itertools.product(*choices):
        # Inserts go where two neighbours don't fit: at most two between any two turns.
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost = sum(c for c, _, _ in picked) + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, out = "", []
            for gap, pick in itertools.zip_longest(gaps, picked):
                for g in gap:
                    audit += "I"
                    out.append(("user" if g == "u" else "assistant", ""))
                if pick:
                    audit += pick[1]
                    out += [pick[2]] if pick[2] else []
            if well_formed("".join(r[:1] if r[:1] else "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def plain_report(turns):
    """turns: (turn, role, text), in any order."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest())
    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=key)
    rows = [(r, x) for _, r, x in turns]
    cost, audit, out = plain_repair(rows)
    numbers, wrong = {t for t, _, _ in turns if t is not None}, faults(rows)
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{f: wrong.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    }


def some_conversations(seed=11):
    rng = random.Random(seed)
    texts, roles = ["", " \t", None, "Yes.", "no", "So?", "wait… ", "é!\n"], ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    out = {}
    for c in range(160):
        out[c if c else None] = [(None if rng.random() < 0.1 else rng.randrange(6) if c % 3 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(3)}.") for t in range(rng.randrange(1, 4))]
    out[900] = [(0, "system", "Be kind."), (1, "user", "a?"), (2, "assistant", "b.")]
    return out


def reports_of(spark, rows, **kw):
    reports = conversations.judge(rows, **kw).cache()
    shas = {r["conv_id"]: r["repaired_sha256"] for r in conversations.digests(conversations.repaired(rows, reports)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: {k: v for k, v in (r.asDict() | {"repaired_sha256": shas.get(r["conv_id"], none)}).items() if k != "conv_id"} for r in reports.collect()}


TURNS = "conv_id long, turn long, role string, text string, digest string, part int"


def test_conversations_by_trying_all_edits(spark):
    given = some_conversations()
    rows = spark.createDataFrame([(c, t, r, x, "d", 1) for c, turns in given.items() for t, r, x in turns], TURNS)
    # Many ranges, so that conversations lie across them, and few.
    assert reports_of(spark, rows, run_rows=3) == reports_of(spark, rows) == {c: plain_report(turns) for c, turns in given.items()}


def plain_fold(rows):
    """The same by a walk over states from left to right, for long conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "")}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for i, (c, a) in list(out.items()):
                for letter in "ua":
                    j = step.get((i, letter))
                    if j is not None:
                        out[j] = min(out.get(j, (10**9, "")), (c + 5, a + "I"))
        return out

    for (role, _), f in zip(rows, faults(rows), strict=True):
        now = {}
        for i, (c, a) in inserted(best).items():
            ways = [(i, 2, "D")]
            if f not in ("blank", "duplicate"):
                ways += [(step.get((i, role[:1])), 5 * (f == "truncated"), "K"), *((step.get((i, x)), 1 + 5 * (f == "truncated"), "R") for x in "ua")]
            for j, more, letter in ways:
                if j is not None:
                    now[j] = min(now.get(j, (10**9, "")), (c + more, a + letter))
        best = now
    ends = inserted(best)
    return min(ends[s] for s in (0, 3) if s in ends)


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(2)
    turns = [(t, rng.choice(["user", "assistant", "system", "tool"]), f"turn {rng.randrange(4000)}{rng.choice('.?x')}") for t in range(3000)]
    rows = spark.createDataFrame([(7, *t) for t in turns] + [(c, 0, "user", "a.") for c in range(5)] + [(9, 0, "user", "b.")], "conv_id long, turn long, role string, text string")
    got = reports_of(spark, rows, run_rows=20)
    plain = [(r, x) for _, r, x in turns]
    wrong = faults(plain)
    assert (got[7]["cost"], got[7]["audit"]) == plain_fold(plain)
    assert [got[7][f] for f in ("blank", "duplicate", "truncated", "gaps")] == [wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), 0]
    assert got[7]["illegal"] == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
    # All turns alike: one of them stays, wherever the ranges fall.
    alike = spark.createDataFrame([(1, 5, "user", "Same.")] * 400, "conv_id long, turn long, role string, text string")
    assert reports_of(spark, alike, run_rows=10)[1] | {"repaired_sha256": 0} == {"gaps": 0, "blank": 0, "duplicate": 399, "truncated": 0, "illegal": 399, "cost": 800, "audit": "D" * 400, "repaired_sha256": 0}


def test_products_may_be_bracketed_at_will():
    rng = random.Random(4)
    kinds = [s | f for s in range(4) for f in (0, conversations.MUST_GO, conversations.CUT)]
    for _ in range(200):
        a, b, c = (conversations.block(tuple(rng.choices(kinds, k=rng.randrange(1, 5)))) for _ in range(3))
        assert conversations.product(conversations.product(a, b), c) == conversations.product(a, conversations.product(b, c))


def test_conversations_query(spark):
    out = {r["conv_id"]: r.asDict() for r in queries.op12_matrix_scan(spark, SF).collect()}
    given = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        own = given.setdefault(r["conv_id"], [])
        code = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = "user" if code == 4 else r["role"], r["text"]
        text = "" if code == 1 else "".join(ch for ch in text if ch not in ".!?") if code == 2 else text
        own += [(r["turn"], role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert set(out) == set(given)
    for c, turns in given.items():
        if len(turns) <= 3:
            assert out[c] == {"conv_id": c, **(plain_report(turns) if turns else nothing)}
        else:
            rows = [(r, x) for _, r, x in sorted(turns, key=lambda t: t[0])]
            assert (out[c]["cost"], out[c]["audit"]) == plain_fold(rows)
    assert queries.damaged(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")).first()["text"] == " "  # crc32(" : ") is dealt no damage


def test_no_conversations(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert reports_of(spark, rows) == {}


# --- hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=10):
    """rows: (vec_id, label, whole numbers)."""
    def score(a, b):
        return sum(int(x) * int(y) for x, y in zip(a, b, strict=False))

    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i is None or not is_anchor(i):
            continue
        scored = [(score(v, w), j, lab, m) for m, (j, lab, w) in enumerate(rows)]
        best = sorted(((s, j) for s, j, lab, m in scored if lab == label and m != n), key=lambda x: order(*x))[:positives]
        for p, j in best:
            fits = sorted(((s, k) for s, k, lab, _ in scored if lab != label and 30 * p <= 100 * s <= 90 * p), key=lambda x: order(*x))[:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out, key=str)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors(seed, n=300, dim=6):
    rng = np.random.default_rng(seed)
    out = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=dim) * rng.choice([0.01, 0.3, 2.0])]) for i in range(n)]
    same = out[1][2]
    out += [(n + k, k % 3, same) for k in range(120)]  # a large group of copies
    out += [(2000, 1, [0.0] * dim), (2100, 2, [0.0] * dim), (2200, None, same), (2300, 1, None), (2400, 1, [None, *same[1:]]), (2500, 1, [math.nan, *same[1:]]), (2600, 1, [math.inf, *same[1:]])]
    return out + [(None, 0, same), (None, 1, same), out[4], out[20], (2700, 1, same[:3]), (2800, 0, [])]


def test_hard_negatives_by_all_scores(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET_VALUES", 48)
    given = vectors(1)
    rows = spark.createDataFrame([(*r, 1.0, 2) for r in given], "vec_id long, label int, embedding array<float>, norm double, place int").repartition(3)
    plain = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in given if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = hard_negatives.mine(hard_negatives.quantised(rows), F.col("id") % 20 == 0, block_values=60)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)
    assert got == plain_negatives(plain, lambda i: i % 20 == 0) and len(got) > 300


@pytest.mark.parametrize("size", [3e4, 2e9])
def test_hard_negatives_of_long_vectors_are_exact(spark, size):
    rng = np.random.default_rng(5)
    plain = [(i, i % 3, [float(x) for x in rng.integers(-int(size), int(size), 4)]) for i in range(60)]
    rows = spark.createDataFrame(plain, "id long, label long, q array<double>")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in hard_negatives.mine(rows, F.col("id") % 10 == 0).collect()), key=str)
    clip = [(i, j, r, k, min(p, hard_negatives.LONG), min(s, hard_negatives.LONG)) for i, j, r, k, p, s in plain_negatives(plain, lambda i: i % 10 == 0)]
    assert got == clip


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(none), F.col("id") % 100 == 0).count() == 0


def test_buckets_are_passed_over(spark):
    """Short rows can't reach an anchor's window: their buckets aren't read."""
    rows = spark.createDataFrame([(i, i % 2, [100.0 if i < 50 else 1.0, float(i % 5)]) for i in range(400)], "id long, label long, q array<double>")
    table = hard_negatives.buckets(rows.withColumn("uid", F.col("id")).withColumn("norm", F.hypot(F.element_at("q", 1), F.element_at("q", 2))), 2)
    anchor = hard_negatives.Block(np.array([0]), np.array([0]), np.array([0]), np.array([[100.0, 0.0]]), False, 10, np.array([[3000]]), np.array([[9000]]))
    assert 29 < anchor.least_norm() < 30.001
    assert table.where(F.col("norm") >= anchor.least_norm()).count() < table.count()


def test_hard_negatives_query(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    plain = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in given]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_norm_buckets(spark, SF).collect()), key=str)
    assert got == plain_negatives(plain, lambda i: i % 100 == 0)
