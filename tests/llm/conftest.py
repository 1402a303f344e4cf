import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text, lang, source), with a column whose name the operators might use themselves."""
    def make(rows):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit("own"), "label": F.lit("own"), "n": F.lit("own"), "key": F.lit("own")})
    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty ones, copies, near copies, shared passages and one long text."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(220)
    rows = [(0, None), (1, ""), (2, "   \n"), (3, "one two"), (4, "One  TWO"), (5, "x" * 350), (6, passage), (7, text(40) + " " + passage + " " + text(30)), (8, passage + " " + text(50)), (9, base), (10, base), (11, base)]
    for i in range(12, 40):
        w = base.split()
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, text(rng.randint(1, 120))) for i in range(40, 70)]
    rows += [(70, text(9000)), (71, "ab" * 400), (72, "🙂" * 120 + passage), (73, passage[:99]), (74, passage[:100])]
    return rows
