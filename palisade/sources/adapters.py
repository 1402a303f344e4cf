"""Telemetry tables derived from the star-schema test tables, so that every query reads given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def access_log(spark, sf_dir) -> DataFrame:
    """events as access-log rows: event_id, source, host, uri, method, status, size, duration, ts."""
    e, k = _events(spark, sf_dir), F.col("k")
    kind, cents = F.col("event_type"), F.col("value") * 100
    # round() goes by decimal objects; halves are exact here, so this is the same
    whole = F.when(cents.between(0, 1e15), F.floor(cents) + F.when(cents - F.floor(cents) >= 0.5, 1).otherwise(0)).otherwise(F.round(cents).cast("bigint"))
    return e.select(
        "event_id", F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("source"),
        F.when(k % 5 == 0, "app.example").when(k % 5 == 1, "app.example:8443").when(k % 5 == 2, "db.example:22").when(k % 5 == 3, "db.example:23").otherwise("db.example:bad").alias("host"),
        F.concat(F.lit("/"), kind, F.lit("/"), (k % 10).cast("string")).alias("uri"),
        F.when(kind == "purchase", "POST").when(kind == "signup", "PUT").otherwise("GET").alias("method"),
        F.when((kind == "error") & (k < 50), 404).when(kind == "error", 500).otherwise(200).alias("status"),
        (whole * 1000).alias("size"), (F.col("value") / 1000).alias("duration"), "ts")


def probes(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("channel"), "ts", (F.col("event_type") != "error").alias("success"))


def host_metrics(spark, sf_dir) -> DataFrame:
    """forks_total is the running sum of k of the user."""
    w = W.partitionBy("host").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = _events(spark, sf_dir).withColumn("host", F.col("user_id").cast("string"))
    return e.select("event_id", "host", "ts", (F.col("value") / 100).alias("load1"), F.lit(4).alias("cpus"), F.sum("k").over(w).cast("bigint").alias("forks_total"))


def connection_paths(spark, sf_dir) -> DataFrame:
    """One path for each user and day: layers of the events in order."""
    layer = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 3)
    e = _events(spark, sf_dir).withColumns({"layer": layer, "day": F.date_trunc("day", "ts")}).where("layer is not null")
    g = e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "layer"))).alias("x"))
    return g.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyyMMdd")).alias("conn_id"), F.col("day").alias("ts"), F.col("x")["layer"].alias("path"))


def lineage_roster(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("peer_id"), F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).alias("is_family"), F.col("c_mktsegment").alias("lineage"))


def peers(spark, sf_dir) -> DataFrame:
    """Peers seen: everyone who ordered, and a few that the roster lacks."""
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return o.select(F.when(F.col("o_custkey") % 50 == 0, F.col("o_custkey") + 100_000_000).otherwise(F.col("o_custkey")).cast("string").alias("peer_id"))


def _snapshot() -> list:
    """An order as a snapshot of a configuration."""
    return [F.col("o_orderpriority").alias("features_json"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("lineage_id"), (F.col("o_totalprice") > 150000).alias("topology_configured"), F.floor(F.col("o_totalprice") / 100000).cast("string").alias("threshold_fingerprint")]


def config_snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(expected, observed): consecutive orders of a customer."""
    o = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    keyed = o.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice", F.lag("o_orderkey").over(w).alias("prev")).where("prev is not null")
    observed = keyed.select(F.col("o_orderkey").cast("string").alias("component_id"), F.col("o_orderdate").alias("ts"), *_snapshot())
    expected = o.withColumn("next", F.lead("o_orderkey").over(w)).where("next is not null").select(F.col("next").cast("string").alias("component_id"), *_snapshot())
    return expected, observed


def config_history(spark, sf_dir) -> DataFrame:
    """The same snapshots in one table: every order, with its customer and its number."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("component_id"), F.col("o_orderdate").alias("ts"), *_snapshot())


def announcements(spark, sf_dir) -> DataFrame:
    """Suppliers announce the part brands of each ship month; months divisible by 7 take the entry back."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = l.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("m", F.date_trunc("month", "l_shipdate"))
    g = j.groupBy("l_suppkey", "m").agg(F.array_sort(F.collect_set("p_brand")).alias("capabilities"))
    return g.select(F.col("l_suppkey").cast("string").alias("primal_id"), "capabilities", F.concat(F.lit("tcp://s"), F.col("l_suppkey").cast("string")).alias("endpoint"), F.col("m").alias("ts"), F.when(F.month("m") % 7 == 0, "remove").otherwise("announce").alias("op"))


def content(spark, sf_dir) -> DataFrame:
    """address, hash, expected_hash: every 50th altered, every 77th missing."""
    d, h = table(spark, sf_dir, "documents"), F.md5(F.col("text").cast("binary"))
    i = F.col("doc_id")
    return d.select(i.cast("string").alias("address"), F.when(i % 77 == 0, None).when(i % 50 == 0, F.concat(F.lit("x"), h)).otherwise(h).alias("hash"), h.alias("expected_hash"))


METHODS = {"view": "security.scan", "click": "health.check", "signup": "baseline.query", "purchase": "defense.quarantine"}


def rpc_calls(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    m = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in METHODS.items()], F.lit("custom.call"))
    params = F.when(F.col("k") % 4 == 0, '{"_auth":{"token":"t"}}').when(F.col("k") % 4 == 1, '{"_auth":{"token":7}}').otherwise("{}")
    origin = F.when(F.col("k") % 3 == 0, "Unix").when(F.col("k") % 3 == 1, "Loopback").otherwise("Remote")
    return e.select("event_id", "ts", m.alias("method"), origin.alias("origin"), F.concat(F.lit("10.0."), F.expr("user_id div 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit(":"), F.col("k").cast("string")).alias("source_addr"), params.alias("params"))


def audit_events(spark, sf_dir) -> DataFrame:
    """Without seq: kind and severity from the event type; the correlation id is the user's."""
    t = F.col("event_type")
    kind = F.when(t == "error", "ThreatDetected").when(t == "purchase", "DefenseAction").when(t == "signup", "GateRejection").when(t == "click", "BaselineObservation").otherwise("LifecycleTransition")
    sev = F.when((t == "error") & (F.col("k") >= 50), "Error").when(t.isin("error", "signup"), "Warn").otherwise("Info")
    action = F.when(F.col("k") % 3 == 0, "Quarantine").when(F.col("k") % 3 == 1, "QuarantineAndAlert").otherwise("MonitorAndAlert")
    return _events(spark, sf_dir).select("event_id", "ts", F.col("user_id").cast("string").alias("source"), sev.alias("severity"), kind.alias("kind"), F.concat(F.lit("t-"), F.col("user_id").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("subject"), F.when(t == "purchase", action).alias("detail"), F.concat(F.lit("t-"), F.col("user_id").cast("string")).alias("correlation_id"))


def negotiations(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    offered = F.when(n % 4 == 0, F.array(F.lit("null"), F.lit("chacha20-poly1305"))).when(n % 4 == 1, F.array(F.lit("hmac-plain"))).when(n % 4 == 2, F.array(F.lit("null"))).otherwise(F.array(F.lit("chacha20-poly1305")))
    bond = F.when(n % 3 == 0, "Covalent").when(n % 3 == 1, "Metallic").when(n % 5 == 0, None).otherwise("Ionic")
    return o.select(n.cast("string").alias("session_id"), offered.alias("offered"), bond.alias("bond_type"), (n % 7 != 0).alias("has_key"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


def nodes(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("primal").alias("node_type"))
    p = table(spark, sf_dir, "part").where("p_size <= 45").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("service").alias("node_type"))
    return s.unionByName(p)


def flows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to"), F.lower("l_returnflag").alias("protocol"), F.col("l_quantity").alias("bytes"), F.col("l_shipdate").alias("day"))


def quarantine_changes(spark, sf_dir) -> DataFrame:
    """purchase enters, signup releases; source is the user's address."""
    e = access_log(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id")
    return e.where("event_type in ('purchase', 'signup')").select("event_id", "source", "ts", F.when(F.col("event_type") == "purchase", "enter").otherwise("release").alias("op"), F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("threat_id"))
