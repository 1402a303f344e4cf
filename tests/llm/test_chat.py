"""The event fold, the template and its mask against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import chat
from palisade.llm import queries as Q
from tests.compare import duck, same

EVENT = "conv_id long, turn long, nth int, seq long, kind string, role string, text string"
MARKS = ["<|im_end|>", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|", "<\\\\/s>", "[\\INST]", "<start_of_turn>", "\\", "<", "[", "|>", "é", "🙂", "\n", "$1", ""]


def fold(events):
    """{conversation: {(turn, nth): (role, text)}} event by event."""
    out = {}
    for c, turn, nth, _, kind, role, text in sorted(set(events), key=lambda e: (e[3], e[4])):
        m, at = out.setdefault(c, {}), (turn, nth)
        if kind in chat.CUTS:
            for k in [k for k in m if k > at]:
                del m[k]
        if kind in chat.BEGINS:
            m.pop(at, None)
        if kind == "delete" or kind not in ("delta", *chat.BEGINS):
            continue
        old = m.get(at, ("", ""))
        m[at] = (role if role is not None else old[0], old[1] + (text or ""))
    return {c: m for c, m in out.items() if m}


def test_fold_against_plain_python(spark):
    rng = random.Random(3)
    events = [(c, rng.randint(0, 9) if c else rng.randint(0, 1400), rng.randint(0, 1), i, rng.choices(["delta", "amend", "delete", "edit", "regenerate", "ping"], [12, 2, 1, 1, 1, 1])[0], rng.choice([None, "user", "assistant"]), rng.choice([None, *MARKS, "words and more"]))
              for i, c in enumerate(rng.choices([0, 1, 2, 3], [6, 1, 1, 1], k=2500))]
    rng.shuffle(events)
    log = spark.createDataFrame(events + events[::3], EVENT).withColumns({"block": F.lit("own"), "pieces": F.lit("own"), "cut": F.lit("own")})
    got = {}
    for r in chat.reconstruct(log).collect():
        got.setdefault(r["conv_id"], {})[r["turn"], r["nth"]] = (r["role"], r["text"])
    assert got == fold(events)


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(4)
    texts = MARKS + ["".join(rng.choices(MARKS, k=rng.randint(1, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert not [r["e"] for r in rows for m in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>") if m in r["e"]]


def test_rendered_text_and_mask_read_back(spark):
    rng = random.Random(5)
    rows = [(c, t, 0, rng.choice([None, "user", "assistant", "odd<|im_sep|>\nrole"]), "".join(rng.choices(MARKS, k=rng.randint(0, 6))) if rng.random() < .9 else None) for c in (1, 2) for t in range(600 if c == 1 else 5)]
    rows += [(None, None, None, "assistant", "x"), (3, 1, 1, "assistant", "same"), (3, 1, 1, "assistant", "same"), (4, 0, 0, "assistant", "long " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, nth int, role string, text string").withColumns({"part": F.lit("own"), "at": F.lit("own")})
    out = {r["conv_id"]: r for r in chat.render(df).select("conv_id", "formatted", "loss", chat.parts(F.col("formatted")).alias("p")).withColumn("back", chat.parse(F.col("p"))).collect()}
    assert set(out) == {None, 1, 2, 3, 4}
    for c, r in out.items():
        want = [(x[3] or "", x[4] or "") for x in rows if x[0] == c]
        assert [(t["role"], t["text"]) for t in r["back"]] == want
        assert [s["turn"] for s in r["loss"]] == [i for i, (role, _) in enumerate(want) if role == "assistant"]
        for s in r["loss"]:  # code points of the whole string and of the turn's part
            under = r["formatted"][s["start"]:s["start"] + s["length"]]
            assert r["formatted"][s["start"] - s["within"]:].startswith(chat.START) and r["formatted"][s["start"] + s["length"]:].startswith(chat.END)
            assert len(under) >= len(want[s["turn"]][1]) and ("\\" in under or under == want[s["turn"]][1])
    assert chat.render(df.limit(0)).count() == 0 and chat.reconstruct(spark.createDataFrame([], EVENT)).count() == 0


def test_log_of_rows_gives_them_back(spark):
    """Ties, repeated rows, null columns and a long text; digests by hashlib."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b" * 50_000), (1, 1, None, None), (None, None, None, None), (None, 3, "assistant", "n"), (2, -5, "assistant", chat.START), (2, 700, "assistant", ""), *[(9, i, "assistant", f"turn {i}") for i in range(900)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nth", F.lit("own"))
    got = {r["conv_id"]: r for r in chat.digest(chat.render(chat.reconstruct(chat.as_log(df)))).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (None, 1, 2, 9):
        mine = sorted((x for x in rows if x[0] == c), key=key)
        learned = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(mine), sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), sha(learned))


def test_query_equals_sql(spark, sf):
    same(Q.op11_chat(spark, sf), duck(sf).execute(Q.ORACLE_SQL["op11_chat"]).df())


def test_no_python_in_the_plan(spark, sf):
    plan = Q.op11_chat(spark, sf)._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas", "ExternalRDD") if w in plan]


@pytest.mark.parametrize("turns", [1, 4])
def test_blocks_do_not_matter(spark, monkeypatch, turns):
    monkeypatch.setattr(chat, "TURNS", turns)
    test_fold_against_plain_python(spark)
    test_rendered_text_and_mask_read_back(spark)
