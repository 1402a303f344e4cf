import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import audit as A
from palisade.operators import observations as O
from palisade.plans.protocols import FileSink
from palisade.sources import adapters as T
from palisade.sources import io
from palisade.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
FULL = '{"request":{"remote_ip":"203.0.113.50","host":"h:8443","uri":"/x.js","method":"GET","headers":{"User-Agent":["u"]}},"status":404,"size":1234,"duration":0.5,"ts":1783788660.123}'


def test_log_lines(spark):
    lines = spark.createDataFrame([(x,) for x in (FULL, '{"request":{"remote_ip":"10.0.0.1"},"status":200,"ts":1.0}', "not json", "", "  ", "{}", '{"request":{"remote_ip":"a"},"status":"x","ts":1.0}')], "value string")
    good, bad = io.split_malformed(lines)
    got = good.orderBy("size").collect()
    assert (got[0]["size"], got[0]["uri"], got[0]["method"]) == (0, "", "") and got[1]["ts"] == dt.datetime(2026, 7, 11, 16, 51, 0, 123000)
    assert bad.count() == 3


def test_observation_json(spark):
    lines = [json.dumps({"connection_rate": 1.5, "traffic_volume": 3, "ports_accessed": [22], "timestamp": {"secs_since_epoch": 5, "nanos_since_epoch": 1999}}), json.dumps({"connection_rate": 1.5, "traffic_volume": -3, "ports_accessed": [], "timestamp": {"secs_since_epoch": 5, "nanos_since_epoch": 0}}), "x"]
    good, bad = io.observations_from_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 1 and bad.count() == 2
    back = json.loads(io.observations_to_json(good).first()["value"])
    assert "http" not in back and back["timestamp"] == {"secs_since_epoch": 5, "nanos_since_epoch": 1000}


def test_threat_json(spark):
    base = {"id": "i", "severity": "High", "source": "s", "target": "t", "detected_at": {"secs_since_epoch": 1, "nanos_since_epoch": 0}, "description": "d", "confidence": 0.5}
    rows = [base | {"threat_type": {"DenialOfService": {"current_load": 0.95, "threshold": 0.9}}}, base | {"threat_type": {}}, base | {"severity": "Odd", "threat_type": {"DenialOfService": {}}}]
    good, bad = io.threats_from_json(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
    assert [r["category"] for r in good.collect()] == ["DenialOfService"] and bad.count() == 2


def test_quarantine_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    assert io.load_quarantine(spark, path).count() == 0
    for n in (1, 2):
        q = io.load_quarantine(spark, path).unionByName(spark.createDataFrame([(f"s{n}", T0, "r", "t")], "source string, started_at timestamp, reason string, threat_id string"))
        io.save_quarantine(q, path)
    assert io.load_quarantine(spark, path).count() == 2


def test_quarantine_that_cannot_be_read_is_empty(spark, tmp_path):
    row = lambda n: spark.createDataFrame([(f"s{n}", T0, "r", "t")], "source string, started_at timestamp, reason string, threat_id string")
    path = f"file://{tmp_path}/q"
    io.save_quarantine(row(1), path)
    version = io.save_quarantine(row(2), path)
    assert [r["source"] for r in io.load_quarantine(spark, path).collect()] == ["s2"]
    for f in (tmp_path / "q" / "versions" / version).glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "q" / "versions" / version).glob(".*.crc"):
        f.unlink()
    assert io.load_quarantine(spark, path).collect() == []
    io.save_quarantine(row(3), path)
    assert [r["source"] for r in io.load_quarantine(spark, path).collect()] == ["s3"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for fmt in ("json", "csv"):
        io.export(df, fmt, f"file://{tmp_path}/{fmt}")
        assert spark.read.format(fmt).schema("x int, y string").option("header", "true").load(f"file://{tmp_path}/{fmt}").collect() == df.collect()
    with pytest.raises(ValueError):
        io.export(df, "xml", "x")


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-c").option("path", f"{tmp_path}/{name}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """Telemetry as files in order of time, to be read as streams."""
    base = tmp_path_factory.mktemp("streams")
    for name, df in (("log", T.access_log(spark, sf)), ("probes", T.probes(spark, sf)), ("metrics", T.host_metrics(spark, sf)), ("changes", T.quarantine_changes(spark, sf)), ("audit", A.with_seq(T.audit_events(spark, sf), "ts", "event_id"))):
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"file://{base}/{name}")
    return base


def source(spark, files, name):
    schema = spark.read.parquet(f"file://{files}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"file://{files}/{name}")


def test_stream_windows_equal_batch(spark, sf, files, tmp_path):
    got = run(jobs.stream_observations(source(spark, files, "log"), "1 day", "1 hour"), tmp_path, "w")
    last = got.agg(F.max("ts")).first()[0]
    want = O.aggregate_windows(spark.read.parquet(f"file://{files}/log"), "1 day").where(F.col("ts") <= F.lit(last))
    cols = ["source", "ts", "connection_rate", "traffic_volume", "ports_accessed", "path_diversity", "method_diversity"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_stream_log_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(FULL + "\nbad\n")
    out = run(io.stream_access_log(spark, str(tmp_path / "in")), tmp_path, "tail")
    assert out.count() == 1
    (tmp_path / "in" / "b.log").write_text(FULL + "\n")
    assert run(io.stream_access_log(spark, str(tmp_path / "in")), tmp_path, "tail").count() == 2


def test_stream_profile_equals_batch(spark, sf, files, tmp_path):
    s = source(spark, files, "log")
    got = run(jobs.stream_score(s.select(F.col("source").alias("key"), F.col("event_id").alias("id"), "ts", F.col("size").alias("value")), include_self=False), tmp_path, "p")
    want = O.metric_baseline(spark.read.parquet(f"file://{files}/log"), "source", "size", ("ts", "event_id"))
    pick = lambda d, i: {r[0]: (r[1], r[2]) for r in d.select(i, F.round("z", 6), "anomalous").collect()}
    assert pick(got, "id") == pick(want, "event_id")


def test_stream_connectivity_and_rates(spark, sf, files, tmp_path):
    got = {r["id"] for r in run(jobs.stream_connectivity(source(spark, files, "probes")), tmp_path, "f").collect()}
    want = O.failure_rate(spark.read.parquet(f"file://{files}/probes"), order=("ts", "event_id")).where("probes >= 3 and failure_rate > 0.5")
    assert got == {r["event_id"] for r in want.collect()}
    got = {r["id"]: round(r["rate"], 9) for r in run(jobs.stream_counter_rate(source(spark, files, "metrics")), tmp_path, "r").collect()}
    want = O.counter_rate(spark.read.parquet(f"file://{files}/metrics"), order=("ts", "event_id"))
    assert got == {r["event_id"]: round(r["rate"], 9) for r in want.collect()}


def test_stream_quarantine(spark, files, tmp_path):
    got = run(jobs.stream_quarantine(source(spark, files, "changes")), tmp_path, "q")
    ch = spark.read.parquet(f"file://{files}/changes")
    assert got.count() == ch.count()
    held = {r["id"]: r["held"] for r in got.collect()}
    assert held == {r["event_id"]: r["op"] == "enter" for r in ch.collect()}


def test_forwarding_delivers_to_both_and_retries(spark, files, tmp_path):
    a, b, failed = FileSink(f"{tmp_path}/a"), FileSink(f"{tmp_path}/b"), []

    def flaky(batch, batch_id):
        if not failed:
            failed.append(batch_id)
            raise OSError("sink is away")
        b.publish(batch, batch_id)

    stream = source(spark, files, "audit")
    with pytest.raises(Exception):
        jobs.forward_audit(stream, a.publish, flaky, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    jobs.forward_audit(stream, a.publish, flaky, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    n = A.min_severity(spark.read.parquet(f"file://{files}/audit"), "warn").count()
    assert spark.read.parquet(f"{tmp_path}/a").count() == n == spark.read.parquet(f"{tmp_path}/b").count()


def test_rings_equal_moments_of_each_window():
    rng = np.random.default_rng(0)
    rows, ring = rng.normal(1e6, 1, (5000, 2)), rng.normal(1e6, 1, (7, 2))
    rows[rng.random(5000) < 0.3, 1] = np.nan
    rows[100:160, 0] = 5.0
    every = np.concatenate([ring, rows])
    for own in (True, False):
        n, mean, std = jobs.over_ring(ring, rows, 20, own)
        for i in (0, 1, 12, 13, 14, 150, 2047, 2048, 4999):
            w = every[max(0, 7 + i + own - 20): 7 + i + own]
            assert n[i] == len(w) and np.allclose(mean[i], np.nanmean(w, axis=0)) and np.allclose(std[i], np.nanstd(w, axis=0), atol=1e-9)
        assert std[150, 0] == 0.0
    n, mean, std = jobs.over_ring(np.zeros((0, 1)), np.array([[3.0]]), 5, False)
    assert n[0] == 0 and np.isnan(mean[0, 0]) and np.isnan(std[0, 0])


def test_sessions_are_forgotten(spark, tmp_path):
    schema = "session_id string, id long, ts timestamp"

    def call(i, *names):
        spark.createDataFrame([(s, i, T0 + dt.timedelta(seconds=i)) for s in names], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
        out = jobs.stream_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/calls"), 4000)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/known").trigger(processingTime="1 second").start()
        until = time.time() + 60
        while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.3)
        q.stop()
        return {r["session_id"]: r["known"] for r in spark.read.parquet(f"{tmp_path}/known").where(f"id = {i}").collect()}

    assert call(1, "a", "b") == {"a": False, "b": False}
    time.sleep(6)
    assert call(2, "a", "c") == {"a": False, "c": False}


def test_threat_intel_stream(spark, files, tmp_path):
    sink = FileSink(f"{tmp_path}/intel")
    jobs.threat_intel_stream(source(spark, files, "audit"), "n1", sink.publish, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = A.threat_intel(spark.read.parquet(f"file://{files}/audit"), "n1")
    got = spark.read.parquet(sink.path)
    assert got.count() == want.count() > 0 and {r["source_node"] for r in got.select("source_node").distinct().collect()} == {"n1"}


def test_late_rows_over_batches(spark, tmp_path):
    split = jobs.LateRows(f"file://{tmp_path}/split", "1 hour", "10 minutes")
    rows = lambda *r: spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m) if m is not None else None) for i, m in r], "id long, ts timestamp").coalesce(1)
    schema = rows().schema
    assert split.late(spark, schema).count() == 0 and split.counts(spark).count() == 0
    split.divide(rows((1, 5), (2, 65), (3, None)), 0)  # mark 55: nothing was over before
    split.divide(rows((4, 30), (5, 70)), 1)  # the first hour ends at 60, after the mark; then 60 is reached
    split.divide(rows((6, 59), (7, 60), (8, None), (6, 59)), 2)
    split.divide(rows((9, 1)), 2)  # comes again after its commit: nothing
    split.divide(rows((10, 500)), 3)
    split.divide(rows(), 4)
    split.divide(rows((11, 479), (12, 480)), 5)  # mark 490: the hour from 420 is over, that from 480 is not
    late = sorted((r["id"], r["batch"]) for r in split.late(spark, schema).collect())
    assert late == [(6, 2), (6, 2), (11, 5)]
    assert [(r["n"], r["late"]) for r in split.counts(spark).orderBy("batch").collect()] == [(3, 0), (2, 0), (4, 2), (1, 0), (0, 0), (2, 1)]
    assert sorted(r["id"] for r in run(split.on_time(spark, schema), tmp_path, "on").collect()) == [1, 2, 3, 4, 5, 7, 8, 10, 12]


def test_batch_that_failed_is_divided_again(spark, tmp_path, monkeypatch):
    split = jobs.LateRows(f"file://{tmp_path}/split", "1 hour", "10 minutes")
    d = spark.createDataFrame([(1, T0)], "id long, ts timestamp")
    d.withColumn("_late", F.lit(True)).write.partitionBy("_late").parquet(f"{split.path}/rows/batch=0")  # written, not committed
    assert split.late(spark, d.schema).count() == 0
    split.divide(d, 0)
    assert [r["id"] for r in run(split.on_time(spark, d.schema), tmp_path, "on").collect()] == [1]


def test_end_of_a_stream_leaves_its_source_alone(spark, sf):
    from palisade.queries import QUERIES

    assert QUERIES["t3_stream_flush"](spark, sf).count() == O.aggregate_windows(T.access_log(spark, sf), "1 day").count()


def test_approximate_paths_near_exact_ones(spark, files, tmp_path):
    exact, near = (run(jobs.stream_observations(source(spark, files, "log"), "1 day", "1 hour", e), tmp_path, f"w{e}") for e in (True, False))
    drop = lambda d: sorted(map(str, d.drop("path_diversity").select(sorted(c for c in d.columns if c != "path_diversity")).collect()))
    assert drop(exact) == drop(near) and exact.dtypes == near.dtypes
    assert exact.join(near.withColumnRenamed("path_diversity", "about"), ["source", "ts"]).where("abs(path_diversity - about) > 0.2 * path_diversity + 1").count() == 0


def test_resets_and_seeds_in_a_stream(spark, tmp_path):
    ddl = "key string, id long, ts timestamp, value double, reset boolean"
    row = lambda key, m, v, reset=None: (key, m, T0 + dt.timedelta(minutes=m), v, reset)
    initial = spark.createDataFrame([row("a", -2, 1.0)[:4], row("a", -1, 3.0)[:4]], "key string, id long, ts timestamp, value double")

    def put(name, *rows):
        spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        out = run(jobs.stream_profiles(s, ("value",), 3, False, initial, np.array([[10.0], [20.0]])), tmp_path, "out")
        return {(r["key"], r["id"]): (r["n"], None if r["n"] == 0 else round(r["value_mean"], 6)) for r in out.collect()}

    first = put("one", row("a", 1, 5.0), row("a", 2, 7.0), row("a", 3, None, True), row("a", 3, 9.0), row("a", 4, 1.0), row("b", 1, 2.0), row("c", 5, None, True))
    # the value of the same moment as the reset goes with what is forgotten
    assert first == {("a", 1): (2, 2.0), ("a", 2): (3, 3.0), ("a", 3): (3, 5.0), ("a", 4): (2, 15.0), ("b", 1): (0, None)}
    second = put("two", row("c", 6, 0.0), row("a", 5, 0.0), row("b", 2, None, True), row("b", 3, 4.0))
    assert {k: v for k, v in second.items() if k not in first} == {("c", 6): (2, 15.0), ("a", 5): (3, round(31 / 3, 6)), ("b", 3): (2, 15.0)}
