import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.operators import audit as A
from palisade.operators import detect as D
from palisade.operators import policy as P
from palisade.operators import registry as R
from palisade.operators import respond as Q
from palisade.thresholds import DEFAULTS

T0 = dt.datetime(2024, 1, 1)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("ports,hits", [([22, 3389], 1), ([22, 22], 1), ([22, 80], 0), ([], 0)])
def test_port_scan(spark, ports, hits):
    o = spark.createDataFrame([("s", T0, ports)], "source string, ts timestamp_ntz, ports_accessed array<int>")
    assert D.detect_port_scan(o).count() == hits


@pytest.mark.parametrize("volume,rate,hits", [(1_000_000, 1.0, 1), (100_000, 0.001, 0), (1_000_000, 0.0, 0), (1_000_000, 100.0, 0)])
def test_exfiltration(spark, volume, rate, hits):
    o = spark.createDataFrame([("s", T0, volume, rate)], "source string, ts timestamp_ntz, traffic_volume long, connection_rate double")
    assert D.detect_exfiltration(o).count() == hits


@pytest.mark.parametrize("path,missed,severity", [([1, 4], [2, 3], "High"), ([1, 2, 4], [3], "High"), ([4, 3, 2, 1], [], "Medium"), ([1, 2, 3, 4, 5], [], "Medium"), ([1, 1, 2, 2, 3, 3, 4], [], "Medium")])
def test_topology(spark, path, missed, severity):
    p = spark.createDataFrame([("c", T0, path)], "conn_id string, ts timestamp_ntz, path array<int>")
    t = one(D.detect_topology(p, replace(DEFAULTS, expected_path=(1, 2, 3, 4))))
    assert t["detail"]["topology"]["bypassed"] == missed and t["severity"] == severity
    assert sum(v is not None for v in t["detail"]) == 1


def probes(spark, text):
    return spark.createDataFrame([("c", T0 + dt.timedelta(seconds=i), x == "T") for i, x in enumerate(text)], "channel string, ts timestamp_ntz, success boolean")


def test_connectivity(spark):
    low = replace(DEFAULTS, failure_rate=0.3)
    last = lambda text, th: D.detect_connectivity(probes(spark, text), th).orderBy(F.desc("detected_at")).select("severity", "detected_at").collect()
    assert last("TFFFF", low)[0]["severity"] == "High"  # 0.8 is not above 0.8
    assert last("FFFFF", DEFAULTS)[0]["severity"] == "Critical"
    assert not last("FF", DEFAULTS) and not last("TTTT", DEFAULTS)
    five = replace(DEFAULTS, failure_window=5)
    assert max(r["detected_at"] for r in last("FFFFFTTTTT", five)) == T0 + dt.timedelta(seconds=6)  # then it clears


def test_lineage_three_values(spark):
    peers = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0), ("d", T0)], "peer_id string, ts timestamp_ntz")
    roster = spark.createDataFrame([("a", True, "x"), ("b", False, "y"), ("c", None, None)], "peer_id string, is_family boolean, lineage string")
    got = {r["source"]: (r["severity"], r["confidence"]) for r in D.detect_genetic(peers, roster).collect()}
    assert got == {"b": ("Critical", 0.95), "c": ("Medium", 0.5), "d": ("Medium", 0.5)}


def test_drift_is_null_safe(spark):
    schema = "component_id string, ts timestamp_ntz, features_json string, lineage_id string, topology_configured boolean, threshold_fingerprint string"
    a = spark.createDataFrame([("x", T0, "f", None, True, "t"), ("y", T0, "f", "l", True, "t")], schema)
    b = spark.createDataFrame([("x", T0, "f", None, True, "t"), ("y", T0, "f", None, False, "t")], schema)
    got = {(r["component_id"], r["field"]): (r["expected"], r["observed"]) for r in D.config_drift(a, b).collect()}
    assert got == {("y", "lineage_id"): ('Some("l")', "None"), ("y", "topology_configured"): ("true", "false")}


@pytest.mark.parametrize("severity,conf,action", [("Critical", 0.95, "Quarantine"), ("Critical", 0.9, "MonitorAndAlert"), ("High", 0.75, "QuarantineAndAlert"), ("High", 0.7, "MonitorAndAlert"), ("Medium", 1.0, "MonitorAndAlert")])
def test_decision_limits_are_strict(spark, severity, conf, action):
    t = spark.createDataFrame([("i", "c", severity, "s", conf, T0)], "id string, category string, severity string, source string, confidence double, detected_at timestamp_ntz")
    assert one(Q.evaluate(t))["action_type"] == action
    assert one(Q.evaluate(t, enabled=False))["action_type"] == "MonitorAndAlert"


QS = "source string, started_at timestamp_ntz, reason string, threat_id string"


def test_quarantine_life(spark):
    empty = spark.createDataFrame([], QS)
    req = spark.createDataFrame([("a", T0, None, None), ("", T0, None, None), ("a", T0 + dt.timedelta(1), "again", "t2")], QS)
    q = Q.quarantine(empty, req)
    assert [(r["source"], r["reason"]) for r in q.collect()] == [("a", "again")]
    left, done = Q.release(q, spark.createDataFrame([("a",), ("b",)], "source string"))
    assert left.count() == 0 and {r["source"]: r["released"] for r in done.collect()} == {"a": True, "b": False}


def test_intervals_and_as_of(spark):
    ch = spark.createDataFrame([("a", 1, "enter", 1), ("a", 3, "enter", 2), ("a", 5, "release", 3), ("a", 9, "release", 4)], "source string, s int, op string, event_id int").select("source", (F.lit(T0) + F.make_dt_interval(secs=F.col("s"))).alias("ts"), "op", "event_id", F.col("event_id").cast("string").alias("threat_id"))
    at = spark.createDataFrame([("a", s) for s in range(7)], "source string, s int").withColumn("ts", F.lit(T0) + F.make_dt_interval(secs=F.col("s")))
    got = [r["q_threat"] for r in Q.quarantined_at(at, Q.quarantine_intervals(ch)).orderBy("s").collect()]
    assert got == [None, "1", "1", "2", "2", None, None]


def test_gate(spark):
    rows = [("security.scan", "Remote", "{}", "reject"), ("security.scan", "Remote", '{"_auth":{"token":"x"}}', "allow"), ("security.scan", "Remote", '{"_auth":{"token":1}}', "reject"), ("security.scan", "Unix", None, "allow"), ("health.check", "Remote", "", "allow"), ("unknown", "Remote", "{}", "reject")]
    c = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "method string, origin string, params string, want string, i int")
    assert all(r["decision"] == r["want"] for r in A.gate_audit(c).collect())
    assert {r["decision"] for r in A.gate_audit(c, enforced=False).collect()} == {"allow", "allow-audit"}


def test_health_calls_pass_quarantine(spark):
    c = spark.createDataFrame([("1.1.1.1:9", "health"), ("1.1.1.1:9", "health.x"), ("1.1.1.1:9", "scan"), ("2.2.2.2:9", "scan")], "source_addr string, method string")
    q = spark.createDataFrame([("1.1.1.1", T0, "r", "t")], QS)
    ok, bad = Q.drop_quarantined(c, q)
    assert ok.count() == 3 and one(bad)["method"] == "scan"


def test_audit_paging_and_cursor(spark):
    a = spark.createDataFrame([(i, "Info" if i == 2 else "Warn", i != 4) for i in range(1, 6)], "seq long, severity string, delivered boolean")
    assert [r["seq"] for r in A.audit_page(a, 3).collect()] == [4, 5]
    assert sorted(r["seq"] for r in A.retain_latest(a, 3).collect()) == [3, 4, 5]
    assert one(A.latest_seq(a.limit(0)))["latest_seq"] == 0
    assert (lambda r: (r["cursor"], r["first_failed"]))(one(A.advance_cursor(a))) == (3, 4)
    assert one(A.advance_cursor(a.where("seq < 4")))["cursor"] == 3


def test_registry(spark):
    a = spark.createDataFrame([("p", ["x"], "e1", 1, "announce"), ("p", ["x", "y"], "e2", 2, "announce"), ("q", ["x"], "e", 1, "announce"), ("q", ["x"], "e", 2, "remove")], "primal_id string, capabilities array<string>, endpoint string, ts int, op string")
    reg = R.registry_state(a)
    assert one(reg)["endpoint"] == "e2"
    s = one(R.registry_stats(reg))
    assert (s["providers"], s["capabilities"], s["avg_per_provider"]) == (1, 2, 2.0)
    assert one(R.registry_stats(reg.limit(0)))["avg_per_provider"] == 0.0
    assert R.discover(reg, spark.createDataFrame([("z",)], "capability string")).count() == 0


@pytest.mark.parametrize("host,port", [("a:8443", 8443), ("a", 443), ("a:bad", 443), ("::1", 1), ("a:70000", 443), ("a:", 443), ("a:+22", 22), (None, 443)])
def test_port_of(spark, host, port):
    assert one(spark.createDataFrame([(host,)], "h string").select(S.port_of(F.col("h")).alias("p")))["p"] == port


@pytest.mark.parametrize("offered,bond,key,want", [(["chacha20-poly1305"], "Ionic", True, "chacha20-poly1305"), (["hmac-plain"], "Metallic", True, "null"), (["chacha20-poly1305"], "Ionic", False, "null"), (["null"], None, True, "null")])
def test_cipher(spark, offered, bond, key, want):
    n = spark.createDataFrame([(offered, bond, key)], "offered array<string>, bond_type string, has_key boolean")
    assert one(P.cipher_policy(n))["cipher"] == want


def test_scope(spark):
    t = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("11.0.0.1",), ("bad",), (None,)], "address string")
    s = spark.createDataFrame([("10.0.0.0/8", "owned"), ("10.1.9.0/24", "excluded")], "cidr string, kind string")
    assert [r["address"] for r in P.in_scope(t, s).collect()] == ["10.1.2.3"]


def test_median_profiler_and_protocols(spark):
    from palisade.plans.protocols import FixedPathValidator, MedianProfiler, SigmaProfiler, TableRoster
    from tests.test_observations import SEED, observed

    obs = observed(spark, SEED + [(500, 2048, [9750])])
    assert MedianProfiler().score(obs).where("dimension = 'connection_rate'").count() >= 1
    assert SigmaProfiler().stats(obs).count() == 3
    peers = spark.createDataFrame([("a",)], "peer_id string")
    assert TableRoster(spark.createDataFrame([("a", True), ("b", True)], "peer_id string, is_family boolean")).roster(peers).count() == 1
    p = spark.createDataFrame([("c", T0, [0, 1, 2, 3])], "conn_id string, ts timestamp_ntz, path array<int>")
    assert FixedPathValidator().validate(p).count() == 0


def test_one_pass_finds_what_the_detectors_find(spark, sf):
    from palisade import queries as C
    from palisade.operators import observations as O

    o = C.observed(spark, sf)
    s = O.rolling_score(o, C.TH)
    apart = D.detect_all([D.detect_behavioral(s, C.TH), D.detect_http(s, C.TH), D.detect_port_scan(o, C.TH), D.detect_exfiltration(o, C.TH)])
    both = [sorted(map(str, d.collect())) for d in (apart, D.detect_observations(s, C.TH))]
    assert both[0] == both[1] and len(both[0]) > 20


def test_full_run_scans_each_source_once(spark, sf):
    from palisade import queries as C

    plan = C._all(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8 and plan.count("Window [") <= 6


def test_defense_status(spark):
    q = spark.createDataFrame([("a", T0, "r", "t1"), ("b", T0, "r", "t2")], "source string, started_at timestamp, reason string, threat_id string")
    assert sorted((r["source"], r["threat_id"], r["enabled"], r["auto_response"], r["quarantined_count"]) for r in Q.defense_status(q, auto_response=False).collect()) == [("a", "t1", True, False, 2), ("b", "t2", True, False, 2)]
    none = one(Q.defense_status(q.limit(0), enabled=False))
    assert none["source"] is None and none["quarantined_count"] == 0 and not none["enabled"]


@pytest.mark.parametrize("host,port", [("h:0000000022", 22), ("h:00000000000080", 80), ("h:0", 0), ("h:99999", 443), ("h:123456", 443), ("h:+22", 22), ("h", 443), ("h:", 443)])
def test_ports(spark, host, port):
    assert spark.range(1).select(S.port_of(F.lit(host))).first()[0] == port


def test_table_topology(spark):
    from palisade.plans.protocols import TableTopology

    t = TableTopology(spark.createDataFrame([("a", "primal")], "id string, node_type string"), spark.createDataFrame([("b",)], "id string"))
    flows = spark.createDataFrame([("a", "b", "tcp"), ("a", "b", "tcp"), ("a", "x", "tcp")], "from string, to string, protocol string")
    assert [(r["from"], r["to"], r["n_flows"]) for r in t.edges(t.nodes(), flows).collect()] == [("a", "b", 2)]


def test_blocks_change_no_rate(spark):
    from palisade.operators import observations as O

    rows = [("h" if i % 3 else "g", T0 + dt.timedelta(seconds=i), i * 7 % 50, i % 4 != 0, i) for i in range(300)]
    d = spark.createDataFrame(rows, "host string, ts timestamp, forks_total long, success boolean, event_id long").withColumn("channel", F.col("host"))
    for f in (lambda b: O.counter_rate(d, block=b), lambda b: O.failure_rate(d, block=b), lambda b: O.metric_baseline(d, "host", "forks_total", ("ts",), block=b)):
        plain, cut = f(None), f(100)
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(plain.columns).collect()))
