"""The divergence of sources against plain Python, exact."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import divergence as D
from palisade.llm import queries as Q
from tests.compare import duck, same

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 10**9


def brute(rows, most=200):
    docs = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    groups, df, count = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang].add(source)
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        v = len(kept)
        c = {s: [count[lang, s][t] for t in kept] for s in sources}
        share = lambda ns: [1 + UNIT * (n + 1) // (sum(ns) + v) for n in ns]
        p = {s: share(ns) for s, ns in c.items()}
        q = share([sum(ns) for ns in zip(*c.values())])
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // b for a, b in zip(p[s], p[o]))) for o in sources if o != s]
            terms = [(t, (a - b) ** 2 // b) for t, n, a, b in zip(kept, c[s], p[s], q) if n and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < most}
    return out


def got(df):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé日ßÀ", k=rng.randint(1, 6))) for _ in range(700)]
    pick = lambda n, lo: " ".join(rng.choice(words[lo:lo + 200]) for _ in range(n))
    rows = [(rng.choice(["en", "de"]), f"s{rng.randint(0, 6)}", pick(rng.randint(0, 90), 60 * rng.randint(0, 8))) for _ in range(160)]
    rows += [("en", "hot", "The, THE the-the\tthe\u0085the 1the2")] * 50  # equal rows, case, separators
    rows += [(None, None, "a a a"), ("", None, "a b"), (None, "", "A c"), ("", "other", None), ("en", "no terms", "123 !?"), ("en", "no terms", ""), ("fr", "x", "un"), ("fr", "y", None), ("en", "long", "lang " * 300_000 + pick(5000, 0))]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_python(spark, corpus, small, monkeypatch):
    if small:  # many segments, flushes, slices and passes
        for name, v in (("SEGMENT", 64), ("HELD", 50), ("SLICE", 1000), ("PASS", 200_000)):
            monkeypatch.setattr(D, name, v)
    rows = corpus
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit("own"), "term": F.lit("own"), "total": F.lit("own"), "segment": F.lit("own")}).repartition(5)
    assert got(D.audit(df, most_terms=20)) == brute(rows, 20)


def test_ties_and_limits(spark):
    """Terms of equal value stand in the order of their bytes, across segments too; only most_terms of them are given."""
    words = sorted({chr(97 + i // 26 % 26) + chr(97 + i % 26) * (1 + i // 600) for i in range(700)} | {"é", "z", "日"})
    rows = [("en", s, " ".join(words[i::2] if s == "a" else words[::3])) for s in "ab" for i in range(2) for _ in range(3)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(D.audit(df)) == brute(rows) and D.audit(df.limit(0)).count() == 0


def test_large_counts_are_exact():
    c = np.array([0, 1, 9_223_372_035, 10**12])
    assert D.shares(c, 10**13, 7).tolist() == [1 + UNIT * (n + 1) // (10**13 + 7) for n in c.tolist()]


def test_equal_nodes_are_shared_and_walked_once():
    rng = np.random.default_rng(0)
    counts = np.vstack([np.zeros(1000, np.int64), rng.integers(0, 3, 1000) * (np.arange(1000) < 40), np.repeat([5, 0, 5, 0], 250)])
    trees = D.Trees(np.vstack([counts, counts[1]]))
    assert trees.roots[1] == trees.roots[3] and trees.nodes() < 200
    for i in range(4):
        for j in range(4):
            x, y, times = trees.meet(i, j)
            a, b = (np.vstack([counts, counts[1]])[k] for k in (i, j))
            assert Counter(dict(zip(zip(x.tolist(), y.tolist()), times.tolist()))) == Counter(zip(a.tolist(), b.tolist()))
    assert [len(t) for t in D.Trees(np.array([[7], [7]])).meet(0, 1)] == [1, 1, 1]


def test_query_equals_sql(spark, sf):
    same(Q.op13_divergence(spark, sf), duck(sf).execute(Q.ORACLE_SQL["op13_divergence"]).df())
