import random

import numpy as np
import pytest

from palisade.llm import embed_dedup, ngram_join, suffix_dedup
from palisade.llm.components import components
from tests.llm import helpers


def repeats(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats_equal_brute_force(make_docs, corpus):
    assert repeats(suffix_dedup.remove_repeats(make_docs(corpus))) == helpers.remove_repeats(corpus)


def test_repeats_empty_table_null_id_and_bytes(spark, make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0
    got = suffix_dedup.remove_repeats(make_docs([(None, "a" * 200), (1, "b c")])).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == {None: b"a" * 200, 1: b"b c"}


def test_repeats_of_repeated_rows(make_docs):
    t, u = "".join(random.Random(1).choices("abcdef", k=300)), "other text " * 20
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(make_docs([(1, t), (1, t), (2, t), (1, u), (3, u), (1, "short"), (1, "short")])).collect())
    want = helpers.remove_repeats([(2, u)])[2][1]  # u repeats itself
    assert got == [(1, 5, 0), (1, 5, 0), (1, 220, want), (1, 300, 0), (1, 300, 300), (2, 300, 300), (3, 220, 220)]


def test_repeats_of_frequent_heads(make_docs):
    """A phrase in every document, with few and with many surroundings; one text that holds a phrase thousands of times."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    phrase, lefts, rights = word(64), [word(40) for _ in range(4)], [word(40) for _ in range(4)]
    rows = [(i, word(rng.randint(0, 60)) + phrase + word(rng.randint(30, 60))) for i in range(400)]
    rows += [(i, word(20) + rng.choice(lefts)[-rng.randint(5, 40):] + phrase + rng.choice(rights)[: rng.randint(5, 40)] + word(20)) for i in range(400, 800)]
    other = word(70)
    rows += [(900, "".join(rng.choice(lefts)[-rng.randint(0, 20):] + other + rng.choice(rights)[: rng.randint(0, 30)] for _ in range(2600)))]
    assert repeats(suffix_dedup.remove_repeats(make_docs(rows))) == helpers.remove_repeats(rows)


def test_repeats_in_a_text_of_many_pieces(make_docs):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij", k=600_000))
    rows = [(1, text[:300_000] + text[100_000:300_500] + text[299_000:]), (2, text[250_000:270_000]), (3, "z" * 700_000)]
    assert repeats(suffix_dedup.remove_repeats(make_docs(rows))) == helpers.remove_repeats(rows)


def test_repeats_of_real_rows(spark, sf):
    from palisade.llm import queries as Q

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert repeats(Q.op2_suffix_dedup(spark, sf)) == helpers.remove_repeats(rows)


def test_multikey_sort():
    w = np.random.default_rng(0).integers(0, 3, (500, 6)).astype(np.uint64)
    got = w[suffix_dedup.multikey_sort(w)]
    assert (got == w[np.lexsort(w.T[::-1])]).all()


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(make_docs, corpus, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(make_docs(corpus), n, percent).collect()}
    want = helpers.jaccard_components(corpus, n, percent)
    assert got == want
    assert sum(c != d for d, (_, c) in want.items()) > 5


def test_jaccard_of_frequent_shingles_and_repeated_ids(make_docs, corpus):
    """Shingles in many documents are spread over tasks; documents of one template meet only if they may link."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(100)]
    rows = [*corpus, *[(i, " ".join([f"o{i}x{k}" for k in range(own)] + common)) for i in range(100, 220) for own in [rng.randint(3, 14)]]]
    want = helpers.jaccard_components(rows, 4, 85)
    for hot in (4, 50):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(make_docs(rows), 4, 85, hot=hot).collect()}
        assert got == want
    twice = ngram_join.jaccard_components(make_docs([*rows[5:12], *rows[9:12]]), 4, 85).collect()
    assert len(twice) == 10 and all(r["component_id"] == (9 if r["doc_id"] in (9, 10, 11) else r["doc_id"]) for r in twice)


def test_jaccard_of_real_rows(spark, sf):
    from palisade.llm import queries as Q

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op3_ngram_join(spark, sf).collect()}
    assert got == helpers.jaccard_components(rows, 4, 85)


def test_jaccard_empty_table_and_representatives(make_docs, corpus):
    assert ngram_join.jaccard_components(make_docs([])).count() == 0
    kept = ngram_join.representative(make_docs([*corpus, (None, "a b c d e f")]))
    want = {d for d, (_, c) in helpers.jaccard_components(corpus, 5, 80).items() if c == d} | {None}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns[:2] == ["doc_id", "text"]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5200)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    want = helpers.groups({x for p in pairs for x in p}, pairs)
    assert all(got.get(k, k) == v for k, v in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'own' as id", "'own' as v", "'own' as cell")


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 16))
    x = np.concatenate([centre[rng.integers(0, 30, 500)] + rng.normal(0, 0.12, (500, 16)), rng.normal(size=(300, 16))]).astype(np.float32)
    x[40:60] = x[39]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [None] * 16), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    found, true = sum(got[i]["n_links"] for i in range(800)), int(g.sum()) - 800
    assert 0.9 * true <= found <= true
    for i in range(800):
        assert got[i]["n_links"] <= g[i].sum() - 1
    assert [got[i]["n_links"] for i in range(1000, 1007)] == [0, 0, 0, 0, 0, 1, 1] and got[1006]["component_id"] == 1005
    assert got[45]["component_id"] <= 39 and got[45]["n_links"] >= 20 and not got[45]["kept"] and got[1000]["kept"]


def test_embeddings_blocks_and_empty(spark, monkeypatch):
    x = np.tile(np.eye(4, dtype=np.float32)[0], (90, 1)) + np.arange(90, dtype=np.float32)[:, None] * 1e-4
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    got = embed_dedup.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    assert all(r["n_links"] == 89 and r["component_id"] == 0 for r in got)
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert [r["n_links"] for r in embed_dedup.near_duplicates(vectors(spark, [(1, None)])).collect()] == [0]


@pytest.mark.parametrize("cells", [512, 2048])
def test_embeddings_recall_with_many_cells(spark, monkeypatch, cells):
    rng = np.random.default_rng(3)
    unit = lambda y: y / np.linalg.norm(y, axis=1, keepdims=True)
    a, g = unit(rng.normal(size=(2000, 64))), rng.normal(size=(2000, 64))
    c = rng.uniform(0.951, 0.97, (2000, 1))
    b = c * a + np.sqrt(1 - c * c) * unit(g - (g * a).sum(1, keepdims=True) * a)
    # cells of other vectors, as when a sample of a large table is fitted
    fitted = {64: embed_dedup.spherical_kmeans(unit(rng.normal(size=(8192, 64))), cells)}
    monkeypatch.setattr(embed_dedup, "fit_cells", lambda *args: fitted)
    got = embed_dedup.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))])).collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert all(n in (0, 1) for n, _ in found.values())
    assert sum(found[i + 2000] == (1, i) for i in range(2000)) >= 0.99 * 2000


def test_embeddings_query_equals_brute_force(spark, sf):
    """The registered query over its table with planted near and exact copies: no link is false, and recall is measured."""
    from palisade.llm import queries as Q

    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(7)
    near = [(10**6 + i, (np.array(v) + rng.normal(0, 0.03 * np.linalg.norm(v) / len(v) ** 0.5 * (1 + i % 9), len(v))).tolist()) for i, (_, v) in enumerate(table * 3)]
    rows = table + near + [(2 * 10**6 + k, v) for k, v in table[:50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'own' as rep")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, per_cell=16).collect()}
    x = np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T >= 0.95
    np.fill_diagonal(g, False)
    true = dict(zip((k for k, _ in rows), g.sum(1).tolist(), strict=True))
    assert all(got[k]["n_links"] <= n for k, n in true.items())
    assert sum(true.values()) > 1000 and sum(r["n_links"] for r in got.values()) >= 0.97 * sum(true.values())
    plain = {r["vec_id"]: r["n_links"] for r in Q.op6_embed_dedup(spark, sf).collect()}
    h = x[: len(table)] @ x[: len(table)].T >= 0.95
    assert plain == {k: int(n) - 1 for (k, _), n in zip(table, h.sum(1), strict=True)}


def test_embeddings_repeated_ids_and_ties(spark):
    got = embed_dedup.near_duplicates(vectors(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_embeddings_of_any_magnitude(spark):
    """Squares of these components are infinite or zero in double precision, or the components are infinite as floats."""
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e198]), (3, [1e-200, 0.0]), (4, [1e-200, 1e-202]), (5, [1e39, 1e37]), (6, [0.0, -1e-310]), (7, [0.0, -1e300]), (8, [1.0, 1.0]), (9, [1e308, -1e308]), (10, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (4, 1) for i in (1, 2, 3, 4, 5)}, 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9), 10: (0, 10)}
    floats = spark.createDataFrame([(1, [3e38, 0.0]), (2, [3e38, 3e36]), (3, [1e-40, 0.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(floats).collect()} == {1: 2, 2: 2, 3: 2, 4: 0}
