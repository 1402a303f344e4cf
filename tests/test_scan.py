"""Carry-forward scans and what is built on them, with one key over many partitions, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.operators import observations as O
from palisade.operators import policy as P
from palisade.operators import respond as Q
from palisade.plans.ordered import carried

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


@pytest.mark.parametrize("how", ["last", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carried(spark, how, inclusive):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, None, rng.randint(0, 99)])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(7)
    got = {r["t"]: r["c"] for r in carried(df, ["k"], ["t"], F.col("v"), "c", how, inclusive).collect()}
    for k, t, _ in rows:
        before = [v for q, u, v in rows if q == k and v is not None and (u <= t if inclusive else u < t)]
        assert got[t] == ((before[-1] if how == "last" else max(before)) if before else None)


def fold(times, seconds):
    start, out = None, {}
    for t in sorted(times):
        if start is None or t >= start + seconds:
            start = t
        out[t] = start
    return out


def test_anchored_windows_of_one_log(spark):
    """One log of all rows, another of one row, one without a name, ties and rows without a time; equal to the fold."""
    rng = random.Random(2)
    rows = [("one", rng.randint(0, 4000)) for _ in range(1500)] + [("two", 7), (None, 3), (None, 70)]
    df = spark.createDataFrame([(k, f"s{i % 3}", "", f"/{i}", "GET", 200, 10, 0.0, at(t)) for i, (k, t) in enumerate(rows)] + [("one", "s0", "", "/", "GET", 200, 1, 0.0, None)], "log_id string, source string, host string, uri string, method string, status int, size long, duration double, ts timestamp_ntz")
    got = {(r["log_id"], r["source"], r["ts"]): r["n_requests"] for r in O.anchored_windows(df, 60).collect()}
    want = {}
    for k in ("one", "two", None):
        opened = fold({t for q, t in rows if q == k}, 60)
        for i, (q, t) in enumerate(rows):
            if q == k:
                key = (k, f"s{i % 3}", at(opened[t]))
                want[key] = want.get(key, 0) + 1
    assert got == want
    plan = O.anchored_windows(df, 60)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_one_source_in_and_out_of_quarantine(spark):
    rng = random.Random(3)
    ops = [("x", at(rng.randint(0, 500)), i, rng.choice(["enter", "enter", "release"]), f"t{i}") for i in range(300)] + [("y", at(5), 1, "enter", "y1"), (None, at(5), 2, "enter", "none")]
    changes = spark.createDataFrame(ops, "source string, ts timestamp_ntz, event_id long, op string, threat_id string")
    got = {(r["source"], r["start"], r["end"], r["threat_id"]) for r in Q.quarantine_intervals(changes).collect()}
    want = set()
    for s in ("x", "y", None):
        mine = sorted((o for o in ops if o[0] == s), key=lambda o: (o[1], o[2]))
        want |= {(s, o[1], n[1] if n else None, o[4]) for o, n in zip(mine, [*mine[1:], None]) if o[3] == "enter"}
    assert got == want
    events = [(i, s, at(t)) for i, (s, t) in enumerate([("x", t) for t in range(-5, 520)] + [("y", 4), ("y", 5), ("z", 9), (None, 9)])] + [(9999, "x", None)]
    df = spark.createDataFrame(events, "event_id long, source string, ts timestamp_ntz").withColumn("threat_id", F.lit("own"))
    rows = Q.quarantined_at(df, Q.quarantine_intervals(changes)).collect()
    assert len(rows) == len(events) and {r["threat_id"] for r in rows} == {"own"}
    for r in rows:
        hit = [w[3] for w in want if r["ts"] is not None and w[0] is not None and w[0] == r["source"] and w[1] <= r["ts"] and (w[2] is None or r["ts"] < w[2])]
        assert (r["quarantined"], r["q_threat"]) == (bool(hit), hit[0] if hit else None)


def test_grace_times_that_overlap(spark):
    rng = random.Random(4)
    times = [("x", at(a), at(a + rng.randint(0, 90))) for a in rng.sample(range(1000), 60)] + [("x", at(3), None), (None, at(0), at(999)), ("y", None, at(999))]
    members = spark.createDataFrame(times, "source string, joined_at timestamp_ntz, grace_until timestamp_ntz")
    found = [(i, s, at(t)) for i, (s, t) in enumerate([("x", t) for t in range(0, 1100, 2)] + [("y", 5), (None, 5)])] + [(9999, "x", None)]
    got = {r["id"] for r in P.apply_grace(spark.createDataFrame(found, "id long, source string, detected_at timestamp_ntz"), members).collect()}
    within = lambda s, t: t is not None and s is not None and any(m == s and a is not None and b is not None and a <= t < b for m, a, b in times)
    assert got == {i for i, s, t in found if not within(s, t)}
