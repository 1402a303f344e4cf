"""The interval index of rules against comparing every row with every rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import policy as P

INF, NAN = float("inf"), float("nan")
ROWS, RULES = "id long, a double, b double", "rule_id int, field string, lo double, hi double"


def fires(v, lo, hi):
    """Spark's order: NaN is above all numbers and equals itself."""
    place = lambda x: (1, 0.0) if math.isnan(x) else (0, x)
    return v is not None and (lo is None or place(v) >= place(lo)) and (hi is None or place(v) < place(hi))


def brute(rows, rules):
    return {(i, r) for i, a, b in rows for r, f, lo, hi in rules if fires({"a": a, "b": b}.get(f), lo, hi)}


def sample(seed, n=400, m=60):
    rng = random.Random(seed)
    odd = [None, NAN, INF, -INF, 0.0, -0.0]
    value = lambda: rng.choice(odd) if rng.random() < 0.2 else 7.0 if rng.random() < 0.4 else round(rng.gauss(0, 20), rng.choice([0, 3]))
    rows = [(i, value(), value()) for i in range(n)]
    rules = [(r, rng.choice(["a", "b", "b", "absent", None]), value(), value()) for r in range(m)]
    return rows + rows[:20], rules + [(0, "a", None, None), (1, "b", 7.0, 7.0), (1, "b", 7.0, 7.5)]


@pytest.mark.parametrize(("seed", "cells"), [(1, None), (2, 2), (3, 64)])
def test_index_equals_brute_force(spark, seed, cells):
    rows, rules = sample(seed)
    got = [tuple(r) for r in P.fired(spark.createDataFrame(rows, ROWS), spark.createDataFrame(rules, RULES), ["id"], ["a", "b"], cells).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, rules)


def test_quorum_and_negative_selection(spark):
    rows, rules = sample(4)
    r, u = spark.createDataFrame(rows, ROWS), spark.createDataFrame(rules, RULES)
    hits = brute(rows, rules)
    per_row = {}
    for i, _ in hits:
        per_row[i] = per_row.get(i, 0) + 1
    assert {tuple(x) for x in P.patrol(r, u, ["id"], ["a", "b"], 12).collect()} == {(i, n) for i, n in per_row.items() if n >= 12}
    left = {x["rule_id"] for x in P.select_detectors(u, r, ["id"], ["a", "b"]).collect()}
    assert left == {q for q, *_ in rules} - {q for _, q in hits}


@pytest.mark.parametrize("empty", ["rows", "rules", "values"])
def test_empty_sides(spark, empty):
    rows = [] if empty == "rows" else [(1, None, None)] if empty == "values" else [(1, 2.0, 3.0)]
    rules = [] if empty == "rules" else [(1, "a", None, None)]
    assert P.fired(spark.createDataFrame(rows, ROWS), spark.createDataFrame(rules, RULES), ["id"], ["a", "b"]).count() == 0


def test_a_value_of_most_rows_is_divided(spark):
    """A third of all rows share one value: its cell has as many ways as it fills quantiles."""
    d = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("a"))
    splits, ways = P.value_cells(d, ["a"], 30)[0]
    hot = sum(s <= 5.0 for s in splits)
    assert 8 <= ways[hot] <= 12 and max(w for i, w in enumerate(ways) if i != hot) <= 2
    per_way = d.where("a = 5").groupBy(F.pmod(F.xxhash64("id"), F.lit(ways[hot]))).count().agg(F.max("count")).first()[0]
    assert per_way < 2 * 30_000 / 30


def test_nothing_is_exchanged_by_field_alone(spark):
    rows, rules = sample(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = P.fired(spark.createDataFrame(rows, ROWS), spark.createDataFrame(rules, RULES), ["id"], ["a", "b"])
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert all("_c#" in x and "_w#" in x for x in (p.split(")")[0] for p in plan.split("hashpartitioning(_f")[1:]))
        assert {tuple(x) for x in r.collect()} == brute(rows, rules)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
