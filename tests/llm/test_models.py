import os
import re

import numpy as np
import pytest

from palisade.llm import common as C
from palisade.llm import langid, quality, toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def larger(sf):
    """Tables with enough labels to measure on."""
    other = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    return other if os.path.exists(other) else sf


def test_langid_held_out_accuracy(spark, sf):
    from palisade.llm import queries as Q

    got = Q.op10_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_langid_odd_texts(make_docs):
    docs = make_docs([(i, "the cat and the dog are in the house " * (i % 5 + 1), "en", None) for i in range(60)] + [(i, "der hund und die katze sind im haus " * (i % 5 + 1), "de", None) for i in range(60, 120)] + [(200, None, "en", None), (201, "", "de", None), (202, "123 !!", None, None), (203, "die katze und der hund", None, None), (204, "x" * 300000, None, None)])
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[200]["score"] == 0.0
    assert got[203]["lang_pred"] == "de"
    kept = langid.predict(docs, model).where(~langid.rejected(model))
    assert {0, 60, 203} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (200, 201, 202)").count() == 0
    assert langid.train(make_docs([])) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def held_out(df, score="score"):
    """(recall, precision, area under the curve) of the rows that were not learned from."""
    rows = [(r["score"], r["predicted"], r["label"]) for r in df.collect()]
    hit = sum(p and y for _, p, y in rows)
    good, bad = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    area = sum((g > x) + (g == x) / 2 for g in good for x in bad) / (len(good) * len(bad))
    return hit / len(good), hit / max(1, sum(p for _, p, _ in rows)), area


def test_quality_and_toxicity_held_out(spark, larger):
    from palisade.llm import queries as Q

    labels = spark.read.parquet(f"{larger}/labels.parquet")
    for q, label, least in ((Q.op1_quality, "quality", (0.95, 0.95, 0.98)), (Q.op7_toxicity, "toxic", (0.6, 0.8, 0.85))):
        got = held_out(q(spark, larger).join(labels.select("doc_id", F.col(label).alias("label")), "doc_id").where("held_out and label is not null"))
        assert all(g >= x for g, x in zip(got, least, strict=True)), (label, got)


def test_models_do_not_depend_on_partitions(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    dealt = docs.repartition(5, "text")
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    a, b = (toxicity.train(d, known, epochs=3, steps=0) for d in (docs, dealt))
    assert len(a.values) and (a.weights == b.weights).all() and a.bias == b.bias
    known = labels.select("doc_id", F.col("quality").alias("label"))
    assert quality.train(docs, known) == quality.train(dealt, known)
    a, b = (langid.train(d, steps=50) for d in (docs, dealt))
    assert (a.table == b.table).all() and (a.temperature, a.threshold) == (b.temperature, b.threshold)


M64 = (1 << 64) - 1


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def toxic_score(model, text):
    """Toxicity of one text, word by word."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    w = [mix((sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(x)) + len(x) * 0xD6E8FEB86659FD93) & M64) for x in words]
    seen = {mix(x) >> 64 - toxicity.BITS for x in w}
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        seen |= {mix((x * 0x9E3779B97F4A7C15 + y * salt) & M64) >> 64 - toxicity.BITS for x, y in zip(w, w[gap:])}
    return 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[k]) for k in seen))))


def language(model, text):
    """Language and probability of one text, n-gram by n-gram."""
    b = [c | 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 else 32 for c in text.encode()]
    z, n = np.zeros(len(model.languages)), 0
    for size in langid.SIZES:
        for i in range(len(b) - size + 1):
            gram = b[i:i + size]
            if all(c == 32 for c in gram):
                continue
            h = size
            for c in gram:
                h = (h * 0x01000193 + c * 0x85EBCA6B) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            z, n = z + model.table[h >> 32 - langid.BITS], n + 1
    z = (z / max(1, n) + model.bias) / model.temperature
    return model.languages[int(z.argmax())], 1 / np.exp(z - z.max()).sum()


def test_scores_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    few = sorted((k for k, t in texts.items() if t and len(t) < 4000), key=lambda k: -len(texts[k]))[:40]
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len({got[k] for k in few}) > 1 and all(abs(got[k] - toxic_score(model, texts[k])) < 1e-5 for k in few)
    lang = langid.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, lang).collect()}
    for k in few:
        name, p = language(lang, texts[k])
        assert got[k][0] == (name if re.search("[^\\W\\d_]", texts[k]) else "und") and (got[k][0] == "und" or abs(got[k][1] - p) < 1e-3)


def test_repeated_rows_and_empty_tables(spark, make_docs):
    docs = make_docs([(i % 60, "calm words here" if i % 2 else "awful fool words", "en" if i % 2 else "de", None) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    none = make_docs([])
    own = docs.withColumns({"stats": F.lit("own"), "p": F.lit("own"), "place": F.lit("own")})
    for train, score in ((quality.train, quality.score), (toxicity.train, toxicity.score)):
        model = train(docs, labels)
        out = score(own.drop("score"), model).collect()
        assert len(out) == 120 and {r["stats"] for r in out} == {"own"} and len({(r["text"], r["score"]) for r in out}) == 2
        assert score(none.drop("score"), model).count() == 0 and score(docs.drop("score"), train(none, labels)).count() == 120
    model = langid.train(docs)
    assert langid.predict(own.drop("score"), model).where("p = 'own'").count() == 120 and langid.predict(none.drop("score"), model).count() == 0


def test_quality_odd_rows(spark, make_docs):
    docs = make_docs([(i, "A calm sentence with words. Another one follows here." if i % 2 else "WORD!! WORD!! WORD!! WORD!!") for i in range(80)] + [(100, None), (101, ""), (102, "y" * 300000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).select("doc_id", F.expr("score")).collect()}
    assert got[1] > 0.8 > 0.3 > got[2] and all(0 <= got[i] <= 1 for i in (100, 101, 102))
    assert quality.train(docs, labels.limit(0)).rules == ()


def test_rules_compile_to_the_same_values(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    rules = quality.grow_rules(x, y)
    w, b = quality.fit_lasso(np.column_stack([quality.holds(r, x) for r in rules]).astype(np.float32), y)
    model = quality.RuleModel(tuple(rules), tuple(w), b)
    want = 1 / (1 + np.exp(-(b + sum(wi * quality.holds(r, x) for r, wi in zip(rules, w)))))
    df = spark.createDataFrame([(i, tuple(map(float, r))) for i, r in enumerate(x)], "i int, stats struct<" + ",".join(f"{s}: double" for s in quality.STATS) + ">")
    got = [r["s"] for r in df.select("i", quality.compile_rules(model).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, want) and ((want > 0.5) == (y > 0.5)).mean() > 0.95


def test_toxicity_odd_rows(spark, make_docs):
    docs = make_docs([(i, f"plain words number{i % 7} here" + (" you awful fool" if i % 4 == 0 else "")) for i in range(200)] + [(500, None), (501, ""), (502, "awful fool " * 20000)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.drop("score"), model).collect()}
    assert got[0] > 0.5 > got[1] and got[500] == got[501] and got[502] > 0.5
    assert 0 < (model.weights != 0).sum() < 200
    assert set(toxicity.train(docs, labels.limit(0)).weights) == {0.0}


def test_word_hashes_do_not_depend_on_chunks():
    raw = "aa bb\tcc  aa".encode()
    b = np.frombuffer(raw, np.uint8)
    s, e, before = C.word_spans(b, np.array([0, len(b)]))
    h = C.word_hashes(b, s, e)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3 and before.tolist() == [0, 4]
    s, _, before = C.word_spans(b, np.array([0, 4, len(b)]))
    assert s.tolist() == [0, 3, 4, 6, 10] and before.tolist() == [0, 2, 5]
