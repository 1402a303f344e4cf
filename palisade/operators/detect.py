"""Detectors. Each returns rows of one threat table; `detail` is one struct with a nullable child for each category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.operators import observations as O
from palisade.thresholds import DEFAULTS, Thresholds

#: (child of detail, its type); one child is set in each row.
DETAIL = {
    "genetic": "struct<peer_id: string, lineage: string>", "deviation": "struct<dimension: string, observed: double, mean: double, std_dev: double, deviation: double>",
    "intrusion": "struct<pattern: string, ports: array<int>, ratio: double>", "load": "struct<current: double, limit: double>", "spawn": "struct<rate: double, limit: double>",
    "connectivity": "struct<failure_rate: double, failures: int, probes: int>", "topology": "struct<expected: array<int>, actual: array<int>, bypassed: array<int>>", "drift": "struct<field: string, expected: string, observed: string>"}


def threat(category: str, prefix: str, keys: list[Column], severity: Column, confidence: Column, source: Column, description: Column, child: str, detail: Column, ts: Column, target: str = "local") -> dict[str, Column]:
    """The columns of the threat table."""
    parts = [(detail if k == child else F.lit(None)).cast(t).alias(k) for k, t in DETAIL.items()]
    return {"id": S.threat_id(prefix, *keys), "category": F.lit(category), "severity": severity, "severity_rank": S.rank_of(severity, S.SEVERITY), "source": source.cast("string"), "target": F.lit(target), "detected_at": ts, "description": description, "confidence": confidence.cast("double"), "detail": F.struct(*parts)}


def _rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(k) for k, c in columns.items()])


def threats(df: DataFrame, category: str, prefix: str, keys: list[str], severity: Column, confidence: Column, source: Column, description: Column, child: str, detail: Column, ts: str = "ts", target: str = "local") -> DataFrame:
    return _rows(df, threat(category, prefix, [F.col(k) for k in keys], severity, confidence, source, description, child, detail, F.col(ts), target))


def lineage_check(peers: DataFrame, roster: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """peers plus severity and confidence: family none, stranger Critical, no answer Medium (degraded). Family is left out."""
    j = peers.join(roster.select("peer_id", "is_family", "lineage"), "peer_id", "left").where("is_family is null or not is_family")
    known = F.col("is_family").isNotNull()
    return j.withColumns({"severity": F.when(known, "Critical").otherwise("Medium"), "confidence": F.when(known, th.lineage_confidence).otherwise(th.degraded_lineage_confidence)})


def detect_genetic(peers: DataFrame, roster: DataFrame, th: Thresholds = DEFAULTS, ts: str = "ts") -> DataFrame:
    j = lineage_check(peers, roster, th)
    return threats(j, "GeneticViolation", "genetic", ["peer_id", ts], F.col("severity"), F.col("confidence"), F.col("peer_id"), F.when(F.col("is_family").isNull(), "lineage could not be verified").otherwise("peer is not family"), "genetic", F.struct("peer_id", "lineage"), ts)


def _deviations(found: DataFrame, category: str, prefix: str, target: str) -> DataFrame:
    text = S.behavior_text(F.col("dimension"), F.col("observed"), F.col("mean"), F.col("std_dev"))
    return threats(found, category, prefix, ["source", "ts", "dimension"], F.col("severity"), F.col("confidence"), F.col("source"), text, "deviation", F.struct("dimension", "observed", "mean", "std_dev", "deviation"), target=target)


def detect_behavioral(scored: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    return _deviations(O.anomalies(scored, th), "BehavioralAnomaly", "behavioral", "network")


def detect_http(scored: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    return _deviations(O.http_anomalies(O.anomalies(scored, th)), "HttpBehavioralAnomaly", "http", "http")


def _scan_detail(ports: Column) -> tuple[Column, str, Column]:
    return F.concat(F.lit("sensitive ports "), ports.cast("string")), "intrusion", F.struct(F.lit("port scan").alias("pattern"), ports.alias("ports"), F.lit(None).cast("double").alias("ratio"))


def _exfil_detail(ratio: Column) -> tuple[Column, str, Column]:
    return F.format_string("%.0f bytes a connection", ratio), "intrusion", F.struct(F.lit("data exfiltration").alias("pattern"), F.lit(None).cast("array<int>").alias("ports"), ratio.alias("ratio"))


def detect_port_scan(obs: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Two sensitive ports or more in one observation."""
    d = obs.withColumn("hit", S.suspicious_ports(F.col("ports_accessed"), th)).where(F.size("hit") >= 2)
    return threats(d, "IntrusionAttempt", "port-scan", ["source", "ts"], F.lit("High"), F.lit(th.port_scan_confidence), F.col("source"), *_scan_detail(F.col("hit")))


def detect_exfiltration(obs: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    ratio = S.bytes_per_conn(F.col("traffic_volume"), F.col("connection_rate"))
    d = obs.withColumn("ratio", ratio).where((F.col("traffic_volume") > th.exfil_volume) & S.exceeds(F.col("ratio"), th.exfil_ratio))
    return threats(d, "IntrusionAttempt", "exfil", ["source", "ts"], F.lit("Medium"), F.lit(th.exfil_confidence), F.col("source"), *_exfil_detail(F.col("ratio")))


def fired(df: DataFrame, rules: list[Column], name: str = "_fired") -> DataFrame:
    """df once for each rule that holds, with the rule's number. The array of numbers is plain, not compacted by a lambda:
    so the explosion is compiled, and rules that do not hold cost no row."""
    return df.withColumn(name, F.explode(F.array(*[F.when(r, F.lit(i)) for i, r in enumerate(rules)]))).where(F.col(name).isNotNull())


def detect_observations(scored: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """All detectors of scored observations in one pass over them: behavioral, http, port scan and exfiltration.
    Findings are numbers of rules; ids, texts and details are made once, for the rows that fired."""
    rules = [(kind, k) for k in O.DIMENSIONS for kind in ("behavioral", "http")[: 2 if k in O.HTTP else 1]]
    deviates = [F.col(f"{k}_z").isNotNull() & S.exceeds(F.col(f"{k}_z"), th.sigma) for _, k in rules]
    seen, per_conn = S.suspicious_ports(F.col("ports_accessed"), th), S.bytes_per_conn(F.col("traffic_volume"), F.col("connection_rate"))
    exfil = (F.col("traffic_volume") > th.exfil_volume) & S.exceeds(per_conn, th.exfil_ratio)
    # a lambda among the rules would keep the explosion from being compiled
    found = fired(scored.withColumn("_scan", F.size(seen) >= 2), [*deviates, F.col("_scan"), exfil])
    nth = F.col("_fired")
    of_rule = lambda value: F.coalesce(*[F.when(nth == i, value(k)) for i, (_, k) in enumerate(rules)])
    d = found.select(
        "source", "ts", F.when(nth == len(rules), "port-scan").when(nth == len(rules) + 1, "exfil").when(nth.isin(*[i for i, (kind, _) in enumerate(rules) if kind == "http"]), "http").otherwise("behavioral").alias("kind"),
        of_rule(F.lit).alias("dimension"), *[of_rule(lambda k, x=x: F.col(k + x).cast("double")).alias(name) for name, x in (("observed", ""), ("mean", "_mean"), ("std_dev", "_std"), ("z", "_z"))],
        F.when(nth == len(rules), seen).alias("ports"), F.when(nth == len(rules) + 1, per_conn).alias("ratio"))

    z, kind = F.col("z"), F.col("kind")
    of = lambda deviation, scan, exfil: F.when(kind == "port-scan", scan).when(kind == "exfil", exfil).otherwise(deviation)
    (scan_text, _, scan), (exfil_text, _, exfil) = _scan_detail(F.col("ports")), _exfil_detail(F.col("ratio"))
    deviation = F.struct("dimension", "observed", "mean", "std_dev", F.when(z == float("inf"), -1.0).otherwise(z))
    details = {"deviation": F.when(kind.isin("behavioral", "http"), deviation), "intrusion": F.when(kind == "port-scan", scan.cast(DETAIL["intrusion"])).when(kind == "exfil", exfil.cast(DETAIL["intrusion"]))}
    severity = of(S.severity_of(z, th), F.lit("High"), F.lit("Medium"))
    return d.select(
        F.concat(kind, S.threat_id("", F.col("source"), F.col("ts"), F.col("dimension"))).alias("id"),
        F.when(kind == "behavioral", "BehavioralAnomaly").when(kind == "http", "HttpBehavioralAnomaly").otherwise("IntrusionAttempt").alias("category"),
        severity.alias("severity"), S.rank_of(severity, S.SEVERITY).alias("severity_rank"), F.col("source").cast("string").alias("source"),
        F.when(kind == "behavioral", "network").when(kind == "http", "http").otherwise("local").alias("target"), F.col("ts").alias("detected_at"),
        of(S.behavior_text(F.col("dimension"), F.col("observed"), F.col("mean"), F.col("std_dev")), scan_text, exfil_text).alias("description"),
        of(S.confidence(z, th), F.lit(th.port_scan_confidence), F.lit(th.exfil_confidence)).cast("double").alias("confidence"),
        F.struct(*[details.get(k, F.lit(None)).cast(t).alias(k) for k, t in DETAIL.items()]).alias("detail"))


def _resource(load: Column, th: Thresholds) -> dict[str, Column]:
    return threat("DenialOfService", "dos", [F.col("host"), F.col("ts")], F.lit("High"), F.lit(th.load_confidence), F.col("host"), F.format_string("load %.2f", load), "load", F.struct(load.alias("current"), F.lit(th.load).alias("limit")), F.col("ts"))


def _spawn(th: Thresholds, order: tuple[str, ...]) -> dict[str, Column]:
    rate = F.col("rate")
    return threat("ProcessSpawnAnomaly", "spawn-rate", [F.col(c) for c in ("host", *order)], F.lit("High"), F.lit(th.spawn_confidence), F.col("host"), F.format_string("%.1f new processes a second", rate), "spawn", F.struct(rate.alias("rate"), F.lit(th.spawn_rate).alias("limit")), F.col("ts"))


def detect_resource(metrics: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    load = S.norm_load(F.col("load1"), F.col("cpus"))
    return _rows(metrics.where(load > th.load), _resource(load, th))


def detect_spawn(metrics: DataFrame, th: Thresholds = DEFAULTS, order: tuple[str, ...] = ("ts",), block: int | None = None) -> DataFrame:
    return O.counter_rate(metrics, order=order, block=block).where(F.col("rate") > th.spawn_rate).transform(_rows, _spawn(th, order))


def detect_host(metrics: DataFrame, th: Thresholds = DEFAULTS, order: tuple[str, ...] = ("ts",), block: int | None = None) -> DataFrame:
    """Resource and spawn-rate detectors in one pass over host samples. What fired is a number, from which the columns are made."""
    load = S.norm_load(F.col("load1"), F.col("cpus"))
    found = fired(O.counter_rate(metrics, order=order, block=block), [load > th.load, F.col("rate") > th.spawn_rate])
    spawn = _spawn(th, order)
    return _rows(found, {k: F.when(F.col("_fired") == 0, c).otherwise(spawn[k]) for k, c in _resource(load, th).items()})


def detect_connectivity(probes: DataFrame, th: Thresholds = DEFAULTS, order: tuple[str, ...] = ("ts",), block: int | None = None) -> DataFrame:
    d = O.failure_rate(probes, th, order=order, block=block).where((F.col("probes") >= th.failure_min_probes) & (F.col("failure_rate") > th.failure_rate))
    text = F.format_string("%.0f%% of %d calls failed", F.col("failure_rate") * 100, F.col("probes"))
    return threats(d, "ConnectivityAnomaly", "connectivity", ["channel", *order], F.when(F.col("failure_rate") > th.failure_critical, "Critical").otherwise("High"), F.lit(th.failure_confidence), F.col("channel"), text, "connectivity", F.struct("failure_rate", "failures", "probes"))


def detect_topology(paths: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    expected = F.array(*[F.lit(i) for i in th.expected_path])
    d = paths.withColumns({"expected": expected, "missed": S.bypassed(expected, F.col("path"))}).where("path <> expected")
    return threats(d, "TopologyViolation", "topology", ["conn_id", "ts"], F.when(F.size("missed") > 0, "High").otherwise("Medium"), F.lit(th.topology_confidence), F.col("conn_id"), F.concat(F.lit("bypassed layers "), F.col("missed").cast("string")), "topology", F.struct("expected", "path", "missed"))


FIELDS = ("features_json", "lineage_id", "topology_configured", "threshold_fingerprint")


def _changes(d: DataFrame, prefix: str = "_") -> DataFrame:
    """One row for each field that differs from the one named with the prefix; null equals null."""
    shown = lambda f, c: S.debug_option(c.cast("string")) if f == "lineage_id" else c.cast("string")
    of_field = lambda value: F.coalesce(*[F.when(F.col("_fired") == i, value(f)) for i, f in enumerate(FIELDS)])
    d = fired(d, [~F.col(f).eqNullSafe(F.col(prefix + f)) for f in FIELDS])
    return d.select("component_id", "ts", of_field(F.lit).alias("field"), of_field(lambda f: shown(f, F.col(prefix + f))).alias("expected"), of_field(lambda f: shown(f, F.col(f))).alias("observed"))


def config_drift(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row for each field that differs between two snapshots of a component; null equals null."""
    e = expected.select("component_id", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    return _changes(observed.join(e, "component_id"))


def config_history_drift(history: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """config_drift of each snapshot against the one before it of the same key: one sort of the history instead of a join
    with its shifted copy. `order` must be unique within a key. A key's first snapshot has nothing to differ from, and one
    without a component_id is compared with nothing."""
    w = W.partitionBy(key).orderBy(*order)
    before = {f"_{f}": F.lag(f).over(w) for f in ("component_id", *FIELDS)}
    return _changes(history.withColumns(before).where("component_id is not null and _component_id is not null"))


def _drift(d: DataFrame, th: Thresholds) -> DataFrame:
    sev = F.when(F.col("field").isin("features_json", "lineage_id"), "High").otherwise("Medium")
    return threats(d, "ConfigurationDrift", "drift", ["component_id", "ts", "field"], sev, F.lit(th.drift_confidence), F.col("component_id"), F.concat_ws(" ", F.lit("changed:"), "field"), "drift", F.struct("field", "expected", "observed"))


def detect_drift(expected: DataFrame, observed: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    return _drift(config_drift(expected, observed), th)


def detect_history_drift(history: DataFrame, key: str, order: tuple[str, ...], th: Thresholds = DEFAULTS) -> DataFrame:
    return _drift(config_history_drift(history, key, order), th)


def detect_all(found: list[DataFrame], enabled: bool = True) -> DataFrame:
    """Union of detectors; switched off, the same schema without rows."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out if enabled else out.limit(0)


def threat_summary(t: DataFrame) -> DataFrame:
    return t.select("id", F.col("category").alias("type"), "severity", "source", "confidence", "description")
