"""Stateful streams handle buckets of keys: many keys cost few calls into Python, and no key learns from another."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palisade.plans.scratch import folder
from palisade.streaming import jobs
from palisade.streaming.queries import run


def fed(d, path):
    """A stream of a folder, to which d is added."""
    d.write.mode("append").parquet(path)
    return d.sparkSession.readStream.schema(d.schema).parquet(path)


def test_approvals_share_the_state_and_timer_of_a_bucket(spark):
    path, out, checkpoint = (folder(spark, n) for n in ("in", "out", "checkpoint"))
    begin = F.lit("2024-01-01").cast("timestamp")
    asked = spark.range(600).select(F.col("id").cast("string").alias("threat_id"), "id", (begin + F.make_dt_interval(mins=(F.col("id") % 30).cast("int"))).alias("ts"), F.lit(None).cast("string").alias("decision"))
    denied = asked.where("id % 5 = 0").select("threat_id", "id", (F.col("ts") + F.expr("interval 1 minute")).alias("ts"), F.lit("denied").alias("decision"))
    stream = jobs.stream_approvals(fed(asked.unionByName(denied), path), 5, "0 seconds", buckets=2)
    q = run(stream, out, checkpoint)
    # two values and two timers, the latter by key and by time
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8
    first = {r["threat_id"]: (r["status"], r["ts"].minute) for r in spark.read.schema(stream.schema).parquet(out).collect()}
    # the last row is of minute 29: who asked in minute 24 or later waits
    assert first == {str(i): ("denied", i % 30 + 1) if i % 5 == 0 else ("auto-approved", i % 30 + 5) for i in range(600) if i % 5 == 0 or i % 30 < 24}
    fed(asked.where("id = 0").withColumns({"ts": F.col("ts") + F.expr("interval 1 day")}), path)
    run(stream, out, checkpoint)
    rows = spark.read.schema(stream.schema).parquet(out).collect()
    assert len(rows) == len({r["threat_id"] for r in rows}) == 600


def after(spark, job, ddl, *batches):
    """All rows of a stream that is run after each batch of rows."""
    path, out, checkpoint = (folder(spark, n) for n in ("in", "out", "checkpoint"))
    for rows in batches:
        stream = job(fed(spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_seconds("ts")), path))
        run(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_profiles_of_one_bucket_keep_their_keys_apart(spark):
    rows = [(k, 10 * t + k, t, float(k + t)) for k in range(5) for t in range(1, 7)]
    job = lambda d: jobs.stream_profiles(d, ("value",), 3, include_self=False, buckets=1)
    got = after(spark, job, "key int, id long, ts long, value double", rows[::2], [(k, i, t + 100, v) for k, i, t, v in rows[1::2]])
    for k in range(5):
        values = [v for v in [float(k + t) for t in (1, 3, 5)] + [float(k + t) for t in (2, 4, 6)]]
        mine = sorted((r for r in got if r["key"] == str(k)), key=lambda r: r["ts"])
        assert [r["value"] for r in mine] == values and [r["n"] for r in mine] == [0, 1, 2, 3, 3, 3]
        assert [r["value_mean"] for r in mine[1:]] == [sum(values[max(0, i - 3):i]) / min(i, 3) for i in range(1, 6)]


def test_seeds_and_resets_of_one_bucket_keep_their_keys_apart(spark):
    initial = spark.createDataFrame([(k, i, i, float(100 * k + i)) for k in range(3) for i in range(5)], "key int, id long, ts long, value double").withColumn("ts", F.timestamp_seconds("ts"))
    job = lambda d: jobs.stream_profiles(d, ("value",), 3, False, initial, np.array([[7.0], [9.0]]), buckets=1)
    got = after(spark, job, "key int, id long, ts long, value double, reset boolean", [(0, 1, 50, 1.0, False), (1, 1, 50, 1.0, False), (1, 2, 60, None, True), (1, 3, 70, 1.0, False), (2, 1, 40, None, True)], [(2, 1, 90, 1.0, False), (3, 1, 90, 1.0, False)])
    assert sorted((r["key"], r["n"], r["value_mean"]) for r in got if r["n"]) == [("0", 3, 3.0), ("1", 2, 8.0), ("1", 3, 103.0), ("2", 2, 8.0)]
    assert [r["key"] for r in got if not r["n"]] == ["3"]


def test_quarantine_of_one_bucket_keeps_its_sources_apart(spark):
    job = lambda d: jobs.stream_quarantine(d, buckets=1)
    got = after(spark, job, "source string, event_id long, ts long, op string, threat_id string", [("a", 1, 1, "enter", "t"), ("b", 2, 2, "release", None), ("c", 3, 3, "enter", "t"), ("c", 4, 4, "release", None)], [("a", 5, 5, "release", None), ("b", 6, 6, "enter", "t"), ("c", 7, 7, "enter", "t"), ("a", 8, 8, "release", None)])
    assert sorted((r["id"], r["was_held"], r["held"]) for r in got) == [(1, False, True), (2, False, False), (3, False, True), (4, True, False), (5, True, False), (6, False, True), (7, False, True), (8, False, False)]


class Known(dict):
    """A map state that counts its reads."""

    reads = 0
    exists = dict.__len__

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    updateValue, removeKey = dict.__setitem__, dict.pop


def test_a_bucket_reads_no_state_before_there_is_any_and_is_judged_in_one_pass(monkeypatch):
    rng, passes = np.random.default_rng(5), []
    r = jobs.Ring(7, False, ("u", "v"), np.array([[1.0, np.nan], [3.0, 2.0]]))
    r.rings = Known()
    of = jobs.over_windows
    monkeypatch.setattr(jobs, "over_windows", lambda *a: passes.append(len(a[1])) or of(*a))
    known = {}
    for batch, most in enumerate((12, 3, 12)):
        rows = [(str(k), i, pd.Timestamp(batch, unit="D") + pd.Timedelta(seconds=i), k % 4 == 1 and i == 2, *rng.choice([1.0, 2.0, 2.5, np.nan], 2)) for k in range(50) for i in range(k % most + 1)]
        d = pd.DataFrame(rows, columns=["key", "id", "ts", "reset", "u", "v"]).sample(frac=1, random_state=1)
        got = {(g.key, g.id): g for g in pd.concat(r.handleInputRows((0,), iter([d[:40], d[40:]]), None)).itertuples()}
        assert passes == [int((~d["reset"]).sum())] and r.rings.reads == (50 if batch else 0)
        passes.clear()
        r.rings.reads = 0
        for k, i, _, reset, *uv in rows:
            if reset:
                known[k] = [[1.0, np.nan], [3.0, 2.0]]
                continue
            past, g = np.array(known.setdefault(k, [])[-7:]).reshape(-1, 2), got.pop((k, i))
            assert g.n == len(past)
            for c, mean, std in ((0, g.u_mean, g.u_std), (1, g.v_mean, g.v_std)):
                x = past[~np.isnan(past[:, c]), c]
                assert np.isnan(mean) and np.isnan(std) if not len(x) else np.allclose((mean, std), (x.mean(), x.std()), atol=1e-12)
                assert len(set(x)) != 1 or std == 0
            known[k].append(uv)
        assert not got
