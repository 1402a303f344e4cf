import re

from pyspark.sql import functions as F

from palisade.llm import common as C
from tests.llm import helpers


def test_stages_against_brute_force(spark, sf):
    import corpus_pipeline as P

    docs = C.table(spark, sf, "documents")
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "mixture"]
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = C.save(stage(spark, docs, sf), name)
        assert tuple(docs.columns) == P.COLUMNS
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert len(after) >= 0.98 * len(before)
        if name == "near_duplicates":
            want = helpers.jaccard_components([(d, r["text"]) for d, r in before.items()], 5, 80)
            assert set(after) == {d for d, (_, c) in want.items() if c == d}
        if name == "repeated_passages":
            want = helpers.remove_repeats([(d, r["text"]) for d, r in before.items()])
            assert {d for d in before if d not in after} <= {d for d, w in want.items() if w[1]}
            assert all(r["text"] == before[d]["text"] for d, r in after.items() if not want[d][1])
            assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if want[d][1])
        if name == "benchmark_leaks":
            words = lambda t: re.findall(r"\w+", t.lower())
            grams = {tuple(w[i:i + 13]) for r in C.table(spark, sf, "benchmark").collect() for w in [words(r["text"])] for i in range(len(w) - 12)}
            assert not [d for d, r in after.items() for w in [words(r["text"])] if any(tuple(w[i:i + 13]) in grams for i in range(len(w) - 12))]
    mixed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in docs.collect()} and all(1 <= r["copies"] <= 3 for r in mixed)


def test_run(spark, sf):
    import corpus_pipeline as P

    assert P.run(spark, sf).count() > 0


def test_language_stage_drops_texts_without_letters(make_docs, spark, sf):
    import corpus_pipeline as P

    docs = make_docs([(i, "the cat and the dog are in the house", "en", "s") for i in range(50)] + [(60, "123 456", None, "s"), (61, None, "en", "s"), (62, "", None, "s")])
    assert {r["doc_id"] for r in P.language(spark, docs, sf).collect()} == set(range(50))


OTHER = ("Hyvää päivää, tänään on kaunis ilma ja minä menen kauppaan ostamaan maitoa ja leipää koko perheelle. ", "Dzień dobry, dzisiaj jest piękna pogoda i idę do sklepu kupić mleko oraz chleb dla całej rodziny. ",
         "Сегодня хорошая погода, и я иду в магазин за молоком и хлебом для всей семьи. ", "今日は天気がいいので、家族のために牛乳とパンを買いに行きます。", "asdf jkl qwerty uiop zxcv ")


def test_language_stage_drops_what_is_no_learned_language(spark, sf):
    import random

    import corpus_pipeline as P

    docs = C.table(spark, sf, "documents")
    rng = random.Random(2)
    odd = [t * k for t in OTHER for k in (2, 8)] + [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(n)) for n in (8, 40, 200)]
    odd += ["".join(rng.choices("qxzjkvwy", k=400)), "123 456 !!", "", None]
    planted = spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in P.language(spark, docs.unionByName(planted), sf).collect()}
    clean = {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").collect()}
    assert not [odd[i - 10**6] for i in kept if i >= 10**6]
    assert len(kept & clean) >= 0.995 * len(clean)


def test_stages_on_odd_rows(spark, sf, make_docs):
    """Null and repeated rows, clashing names and an empty table go through every stage."""
    import corpus_pipeline as P

    text = "the cat and the dog are in the house and this is what they said to each other on that day " * 3
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, None, None, None), (None, text + "more", "en", "s"), (3, "", "en", "s"), *[(i, f"number {i} of the texts in this table is not like the others at {i * i}", "en", "t") for i in range(10, 60)]]
    docs = make_docs(rows).withColumns({"size": F.lit("own"), "stats": F.lit("own"), "target": F.lit("own"), "item_id": F.lit("own"), "h": F.lit("own")})
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns[: len(P.COLUMNS)] == list(P.COLUMNS) and stage(spark, docs.limit(0), sf).count() == 0
        assert {r["doc_id"] for r in got} >= set(range(10, 60)) or name == "mixture"
        if name in ("near_duplicates", "repeated_passages", "benchmark_leaks"):
            kept = [r["text"] for r in got if r["doc_id"] == 2]
            assert kept == [None]
        if name == "repeated_passages":
            assert sum(r["doc_id"] == 1 for r in got) == 1  # the second row is all repeats


def test_mixture_stage_takes_what_the_operator_takes(spark, sf):
    import corpus_pipeline as P
    from palisade.llm import queries as Q

    docs = C.table(spark, sf, "documents")
    want = {r["doc_id"]: r["taken"] for r in Q.op8_mixing(spark, sf).where("taken > 0").collect()}
    got = P.mixture(spark, docs, sf).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == want and all(r["copies"] * r["size"] == r["taken"] for r in got)


def test_run_leaves_no_scratch_tables(spark, sf):
    import os

    import corpus_pipeline as P

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) | {"warehouse"}
    rows = P.run(spark, sf).count()
    made = [d for d in os.listdir(base) if d not in before and os.listdir(f"{base}/{d}")]
    assert rows > 0 and len(made) == 1
