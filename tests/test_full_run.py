"""What a full detection run does for each row: no objects for small groups, no cuts for small keys, no ids that nobody reads."""

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.operators import detect as D
from palisade.operators import observations as O
from palisade.plans.ordered import halo
from palisade.sources import adapters as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_need_no_object_aggregates(spark):
    at = datetime(2024, 1, 1, 5)
    rows = [("a", "x:22", "/p", "GET", 200, 100, 0.5, at), ("a", "x:22", "/p", "GET", 404, 101, None, at), ("a", "x:8443", "/q", "", 500, 7, 0.1, at), ("a", "x", "", "PUT", 200, 0, 0.3, at), ("a", None, None, None, 200, 0, None, at),
            ("b", "x", "", "", 200, 1, None, at), ("b", "x", "/p", "GET", 200, 1, None, datetime(2024, 1, 2)), ("b", "x", "/p", "GET", 200, 1, None, None)]
    log = spark.createDataFrame(rows, "source string, host string, uri string, method string, status int, size long, duration double, ts timestamp_ntz")
    o = O.aggregate_windows(log, "1 day")
    assert "ObjectHashAggregate" not in plan(o) and "SortAggregate" not in plan(o)
    got = {(r["source"], r["ts"].day): r for r in o.collect()}
    assert set(got) == {("a", 1), ("b", 1), ("b", 2)}
    a = got["a", 1]
    assert (a["ports_accessed"], a["path_diversity"], a["method_diversity"], a["n_requests"], a["avg_payload_bytes"]) == ([22, 443, 8443], 2, 2, 5, 41)
    assert (a["error_rate_4xx"], a["error_rate_5xx"], a["avg_duration_ms"], a["connection_rate"]) == (0.2, 0.2, 300.0, 5 / 86400)
    b = got["b", 1]
    assert (b["ports_accessed"], b["path_diversity"], b["method_diversity"], b["avg_duration_ms"]) == ([443], 0, 0, None)


def test_only_large_keys_are_cut_up(spark):
    small = spark.range(400).select((F.col("id") % 20).cast("string").alias("k"), "id")
    large = spark.range(1000, 1500).select(F.lit(None).cast("string").alias("k"), "id")
    over = lambda w: {"s": F.sum("id").over(w.rowsBetween(-3, 0))}
    one = halo(small, ["k"], ["id"], 4, over, 50)
    assert "Scan parquet" not in plan(one)  # nothing was ranked and written
    both = small.unionByName(large)
    want = both.withColumns(over(W.partitionBy("k").orderBy("id")))
    got = halo(both, ["k"], ["id"], 4, over, 50)
    assert "Scan parquet" in plan(got)
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(want.collect(), key=lambda r: r["id"])


def test_host_findings_are_names_until_read(spark):
    rows = [("h", 1, datetime(2024, 1, 1), 4.0, 4, 0), ("h", 2, datetime(2024, 1, 1, 0, 0, 1), 0.1, 4, 100), ("h", 3, datetime(2024, 1, 1, 0, 0, 2), 3.9, 4, 200), ("g", 4, datetime(2024, 1, 1), 0.1, 4, 0)]
    m = spark.createDataFrame(rows, "host string, event_id long, ts timestamp_ntz, load1 double, cpus int, forks_total long")
    order = ("ts", "event_id")
    found = D.detect_host(m, order=order)
    assert "sha2" in plan(found) and "sha2" not in plan(found.groupBy("category").count())
    apart = D.detect_resource(m).unionByName(D.detect_spawn(m, order=order))
    assert found.schema == apart.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
    assert sorted((r["category"], r["source"]) for r in apart.collect()) == [("DenialOfService", "h")] * 2 + [("ProcessSpawnAnomaly", "h")] * 2


def test_findings_are_compiled(spark):
    """A lambda in an explosion, or beside it, makes Spark interpret it for each row."""
    o = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0, 5, [22], 1.0, 1, 0.0)], "source string, ts timestamp_ntz, connection_rate double, traffic_volume long, ports_accessed array<int>, request_rate double, path_diversity int, error_rate_4xx double")
    m = spark.createDataFrame([("h", datetime(2024, 1, 1), 4.0, 4, 0)], "host string, ts timestamp_ntz, load1 double, cpus int, forks_total long")
    c = spark.createDataFrame([("c", "1", datetime(2024, 1, 1), "f", "l", True, "t")], "owner string, component_id string, ts timestamp_ntz, features_json string, lineage_id string, topology_configured boolean, threshold_fingerprint string")
    for found in (D.detect_observations(O.rolling_score(o)), D.detect_host(m), D.detect_drift(c, c), D.detect_history_drift(c, "owner", ("ts",))):
        lines = [x for x in plan(found.groupBy("category").count()).splitlines() if "Generate" in x]
        assert lines and not any("lambda" in x for x in lines)


def test_history_drift_is_drift_of_consecutive_snapshots(spark):
    at = lambda day: datetime(2024, 1, day)
    rows = [("a", "1", at(1), "x", None, True, "t"), ("a", "2", at(2), "y", "l", None, "t"), ("a", "3", at(2), "y", "l", None, "t"), ("a", "4", at(3), None, None, True, "u"), ("b", "5", at(1), "x", "l", True, "t"),
            (None, "6", at(1), "x", "l", True, "t"), (None, "7", at(2), "x", "m", True, "t"), ("c", "8", at(1), "x", "l", True, "t"), ("c", None, at(2), "y", "l", True, "t"), ("c", "9", at(3), "z", "l", True, "t")]
    h = spark.createDataFrame(rows, "owner string, component_id string, ts timestamp_ntz, features_json string, lineage_id string, topology_configured boolean, threshold_fingerprint string")
    w = W.partitionBy("owner").orderBy("ts", "component_id")
    expected = h.withColumn("component_id", F.when(F.col("component_id").isNotNull(), F.lead("component_id").over(w)))
    want = D.detect_drift(expected, h)
    got = D.detect_history_drift(h, "owner", ("ts", "component_id"))
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted((r["source"], r["detail"]["drift"]["field"]) for r in got.collect()) == [("2", "features_json"), ("2", "lineage_id"), ("2", "topology_configured"), ("4", "features_json"), ("4", "lineage_id"), ("4", "threshold_fingerprint"), ("4", "topology_configured"), ("7", "lineage_id")]


def test_short_sources_have_frames_that_grow(spark):
    k = F.when(F.col("id") < 130, F.lit("long")).when(F.col("id") < 170, F.lit("short"))
    x = ((F.col("id") * 7919) % 101).cast("double")
    o = spark.range(230).select(k.alias("source"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), x.alias("connection_rate"), x.cast("long").alias("traffic_volume"), F.array(F.lit(22)).alias("ports_accessed"),
                                x.alias("request_rate"), F.when(F.col("id") % 5 > 0, x.cast("int")).alias("path_diversity"), (x / 3).alias("error_rate_4xx"))
    for self_ in (True, False):
        want, got = O.rolling_score(o, include_self=self_), O.rolling_score(o, include_self=self_, stored=True)
        assert got.schema == want.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        few = O.rolling_score(o.where("source = 'short'"), include_self=self_, stored=True)
        assert "unboundedpreceding" in plan(few) and "RowFrame, -" not in plan(few).replace("unboundedpreceding$(), -1", "")


def test_failures_are_counted_by_frames_that_grow(spark):
    rows = [(c, i, datetime(2024, 1, 1, 0, i % 60, i // 60), None if (i * 7) % 11 == 0 else (i * 5) % 3 > 0) for c in ("a", "b", None) for i in range(70 if c == "b" else 25)]
    p = spark.createDataFrame(rows, "channel string, event_id long, ts timestamp_ntz, success boolean")
    order = ("ts", "event_id")
    assert "RowFrame, -19" not in plan(O.failure_rate(p, order=order))
    got = {(r["channel"], r["event_id"]): (r["failures"], r["probes"], r["failure_rate"]) for r in O.failure_rate(p, order=order).collect()}
    cut = {(r["channel"], r["event_id"]): (r["failures"], r["probes"], r["failure_rate"]) for r in O.failure_rate(p, order=order, block=30).collect()}
    assert got == cut and len(got) == len(rows)
    for c in ("a", "b", None):
        of = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(of):
            last = of[max(0, i - 19): i + 1]
            bad = sum(not x[3] for x in last)
            assert got[c, r[1]] == (bad, len(last), bad / len(last))


def test_few_hosts_meet_the_pattern(spark):
    hosts = [None, "", ":", "x", "x:", "x:80", "x:080", "x:+80", "x:-80", "x:+0", "x:0", "x:00000443", "x:65535", "x:65536", "x:70000", "x:123456", "x:99999999999", "x:8.", "x:8.5", "x: 80", "x:80 ", "x:80\n", "x:80\r\n", "x:bad\n", "x:bad", "x:8a", "x:a8", "x:8Z", "x:8_",
             "[::1]:22", "::1", "::", "a:22:23", "a:22:b", "x:8\u2028", "x:\u0661", "x:8\u0301", "\u00e9:22", "x:1e3", "x:0x1f", "x:\t80", "x:65535\u0085", "x@80", "x:80]", "x:80[", "x:80`"]
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    n = F.regexp_extract("host", r":\+?0*([0-9]{1,5})$", 1).try_cast("int")
    for r in d.select("host", S.port_of(F.col("host")).alias("got"), F.when(n.between(0, 65535), n).otherwise(443).alias("want")).collect():
        assert r["got"] == r["want"], r


def test_limits_round_only_what_is_near_them(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -2.5, 2.5, 2.5 + 4e-10, 2.5 + 6e-10, 2.5 - 4e-10, 2.5 + 5e-10, 2.5 + 1e-6, 2.5 - 1e-6, 2.500001, 2.499999, 1e300]
    d = spark.createDataFrame([(v,) for v in values], "z double")
    for limit in (2.5, 0.0, 1000.0, -2.5):
        for r in d.select("z", S.exceeds(F.col("z"), limit).alias("got"), (F.round("z", 9) > limit).alias("want")).collect():
            assert r["got"] == r["want"], (limit, r)


def test_sizes_of_log_rows_are_rounded(spark, tmp_path):
    values = [0.0, 0.004, 0.005, 0.015, 1.005, 2.675, 122.79, 0.285, 1.115, -0.005, -1.015, 12345.675, 0.49999999999999994 / 100, 9e12, 2e13]
    spark.createDataFrame([(i, datetime(2024, 1, 1), 1, "view", v, '{"k": 1}') for i, v in enumerate(values)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    e = T.table(spark, tmp_path, "events").select("event_id", (F.round(F.col("value") * 100).cast("bigint") * 1000).alias("size"))
    assert sorted(T.access_log(spark, tmp_path).select("event_id", "size").collect()) == sorted(e.collect())
