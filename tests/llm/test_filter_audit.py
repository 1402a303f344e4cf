"""The audit stream against a plain Python count, in many files and batches, and its restart."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.llm import filter_audit as FA
from palisade.llm import queries as Q
from tests.compare import duck, same

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, n string, key string"


def masks(rows):
    """(part, letters failed, id) of (doc_id, text, lang)."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t]}
        yield lang or "", {f for f, x in fails.items() if x}, i


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    docs = list(masks(rows))
    out = {}
    for part in {p for p, _, _ in docs}:
        mine = [(m, i) for p, m, i in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        table = {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                table["".join(order), k + 1] = [f, len(left), len(gone), sum(f in m for m, _ in mine) - len(gone), sum(m == {f} for m, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for (order, k), (f, *v) in table.items():
            out[part, order, k] = (*v, shapley[f])
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    pool = ["", None, "x", "A B C", "# short", " ".join(f"w{i}" for i in range(260)), " ".join(["same"] * 300), " ".join(f"W{i} Ü" for i in range(150)), " ".join(f"é{i % 90}" for i in range(250)) + " |", "TITLE " * 90 + "plain " * 400, " ".join(str(i) for i in range(40_000))]
    rows = [(i, rng.choices(pool, [5] + [1] * 10)[0], rng.choice(["en", "de", None, ""])) for i in range(240)] + [(None, "x", "en"), (None, "only once here", "en"), (7, "x", "de"), (7, "x", "en"), (-4, "x", None), (-4, "x", "en")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def put(spark, path, rows, files):
    for k in range(files):  # one by one, so that their order in time is this one
        part = [(*r, "own", "own") for r in rows[k::files]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize(("order", "files"), [("as they come", 1), ("ids fall", 6), ("ids rise", 6)])
def test_against_plain_python(spark, tmp_path, corpus, order, files):
    rows, labels = corpus
    if order != "as they come":
        rows = sorted(rows, key=lambda r: r[0] or 0, reverse=order == "ids fall")
        rows = [r for k in range(files) for r in rows[k * len(rows) // files:(k + 1) * len(rows) // files]]
        size = len(rows) // files + 1
        for k in range(files):
            put(spark, str(tmp_path / "d"), rows[k * size:(k + 1) * size], 1)
    else:
        put(spark, str(tmp_path / "d"), rows, 1)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(FA.audit(FA.stream(spark, str(tmp_path / "d"), 1), known)) == brute(rows, labels)


def test_continues_where_it_stopped(spark, tmp_path, corpus):
    """The same folder again: only new files are read, and smaller ids in them retract what was counted."""
    rows, labels = corpus
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    late, early = [r for r in rows if (r[0] or 0) >= 60], [r for r in rows if (r[0] or 0) < 60]
    put(spark, str(tmp_path / "d"), late, 2)
    run = lambda: got(FA.audit(FA.stream(spark, str(tmp_path / "d"), 1), known, f"file://{tmp_path}/state"))
    assert run() == brute(late, labels)
    put(spark, str(tmp_path / "d"), early, 2)
    assert run() == brute(rows, labels) == run()


def test_local_runs_do_not_matter(spark, tmp_path, corpus, monkeypatch):
    """Tiny runs of rows, slices and passes give the same masks."""
    for name, v in (("LOCAL_ROWS", 3), ("SLICE", 7), ("PASS", 30_000)):
        monkeypatch.setattr(FA, name, v)
    rows, _ = corpus
    for t in {r[1] or "" for r in rows}:
        w = re.findall(WORD, t)
        assert FA.words(t.encode()) == (len(w), len(set(w)))
    test_against_plain_python(spark, tmp_path, corpus, "as they come", 1)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    assert FA.audit(FA.stream(spark, str(tmp_path / "d")), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_query_equals_sql(spark, sf):
    same(Q.op12_filter_audit(spark, sf), duck(sf).execute(Q.ORACLE_SQL["op12_filter_audit"]).df())


def test_long_text_in_bounded_memory():
    import tracemalloc

    b = b" ".join(b"%d" % i for i in range(300_000))
    peaks = []
    passes = FA.PASS
    for FA.PASS in (passes, len(b) // 16):
        tracemalloc.start()
        assert FA.words(b) == (300_000, 300_000)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    FA.PASS = passes
    assert peaks[1] < 24 << 20 and peaks[1] < peaks[0]
