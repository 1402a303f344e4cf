"""The audit trail: building events, numbering, paging, retention, forwarding, and counters over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.plans.ordered import global_rank
from palisade.thresholds import DEFAULTS, Thresholds


def to_audit(df: DataFrame, kind: str, severity: Column | str, source: Column, subject: Column, detail: Column | None = None, correlation: Column | None = None, ts: str = "ts") -> DataFrame:
    """Events of one kind without sequence numbers."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    none = F.lit(None).cast("string")
    return df.select(F.col(ts).alias("ts"), source.alias("source"), sev.alias("severity"), S.rank_of(sev, S.AUDIT_SEVERITY).alias("severity_rank"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), (none if detail is None else detail.cast("string")).alias("detail"), (none if correlation is None else correlation).alias("correlation_id"))


def threat_events(threats: DataFrame) -> DataFrame:
    return to_audit(threats, "ThreatDetected", "Warn", F.col("source"), F.col("id"), F.concat_ws(" ", "severity", "category"), F.col("id"), "detected_at")


def action_events(actions: DataFrame) -> DataFrame:
    return to_audit(actions, "DefenseAction", "Info", F.col("target"), F.col("threat_id"), F.col("action_type"), F.col("threat_id"), "decided_at")


def gate_events(gated: DataFrame) -> DataFrame:
    """Rejections and permissive allowances of a gate audit."""
    bad = to_audit(gated.where("decision = 'reject'"), "GateRejection", "Warn", F.col("source_addr"), F.col("method"), F.col("origin"))
    soft = to_audit(gated.where("decision = 'allow-audit'"), "GatePermissiveAllow", "Warn", F.col("source_addr"), F.col("method"), F.col("origin"))
    return bad.unionByName(soft)


def observation_events(obs: DataFrame) -> DataFrame:
    return to_audit(obs, "BaselineObservation", "Info", F.col("source"), F.col("source"), F.round("connection_rate", 9))


def lifecycle_events(changes: DataFrame) -> DataFrame:
    return to_audit(changes, "LifecycleTransition", "Info", F.col("service"), F.col("service"), F.concat_ws("->", "from_state", "to_state"))


def with_seq(events: DataFrame, *order: str) -> DataFrame:
    """Gap-free numbers from 1 in arrival order, without a single task."""
    return global_rank(events, *order, name="seq")


def audit_page(audit: DataFrame, since: int = 0, limit: int = 100) -> DataFrame:
    """Events after a cursor; at most 1000."""
    return audit.where(F.col("seq") > since).orderBy("seq").limit(min(limit, 1000))


def retain_latest(audit: DataFrame, capacity: int = DEFAULTS.audit_capacity) -> DataFrame:
    """The newest `capacity` events: a bound on seq, not a sort."""
    top = audit.agg(F.max("seq").alias("_top"))
    return audit.join(F.broadcast(top)).where(F.col("seq") > F.col("_top") - capacity).drop("_top")


def latest_seq(audit: DataFrame) -> DataFrame:
    return audit.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("latest_seq"))


def min_severity(df: DataFrame, level: str) -> DataFrame:
    """Events of a level or above. `critical` counts as Error and an unknown level as Warn."""
    rank = {"info": 0, "warn": 1, "error": 2, "critical": 2}.get(level.lower(), 1)
    return df.where(S.rank_of(F.col("severity"), S.AUDIT_SEVERITY) >= rank)


def advance_cursor(batch: DataFrame, level: str = "Warn") -> DataFrame:
    """batch (seq, severity, delivered) -> (cursor, first_failed): the last seq before the first failed delivery.

    Events below the level count as delivered. The cursor is null if the first event failed already.
    """
    due = S.rank_of(F.col("severity"), S.AUDIT_SEVERITY) >= S.AUDIT_SEVERITY.index(level)
    b = batch.withColumn("_bad", due & ~F.col("delivered"))
    fail = b.agg(F.min(F.when(F.col("_bad"), F.col("seq"))).alias("first_failed"))
    return b.join(F.broadcast(fail)).groupBy("first_failed").agg(F.max(F.when(F.col("first_failed").isNull() | (F.col("seq") < F.col("first_failed")), F.col("seq"))).alias("cursor"))


def threat_intel(audit: DataFrame, node_id: str) -> DataFrame:
    """Detections of Warn and above as records for other nodes."""
    t = audit.where("kind = 'ThreatDetected'")
    return min_severity(t, "warn").select(F.lit(node_id).alias("source_node"), F.col("detail").alias("threat_type"), F.col("source").alias("threat_source"), "severity", F.col("subject").alias("description"), F.col("ts").alias("detected_at"), F.lit(None).cast("string").alias("evidence"))


def security_metrics(audit: DataFrame) -> DataFrame:
    """Counters in one row: detected, mitigated, quarantined, alerts, scans."""
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    act = F.col("kind") == "DefenseAction"
    return audit.agg(
        hit(F.col("kind") == "ThreatDetected").alias("detected"), hit(act).alias("mitigated"), hit(act & F.col("detail").isin("Quarantine", "QuarantineAndAlert")).alias("quarantined"),
        hit(act & F.col("detail").isin("QuarantineAndAlert", "MonitorAndAlert")).alias("alerts"), hit(F.col("kind") == "ScanPerformed").alias("scans"), F.max("ts").alias("last_updated"))


def http_metrics(verdicts: DataFrame, count_blocks: bool = True) -> DataFrame:
    v = verdicts if count_blocks else verdicts.where("verdict <> 'block'")
    hit = lambda x: F.coalesce(F.sum(F.when(F.col("verdict") == x, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return v.agg(F.count(F.lit(1)).alias("screened"), hit("allow").alias("allows"), hit("warn").alias("warns"), hit("block").alias("blocks"))


def correlate(threats: DataFrame, actions: DataFrame, audit: DataFrame) -> DataFrame:
    """Threats with their action and the number of audit events of their correlation id."""
    n = audit.where("correlation_id is not null").groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_event"))
    return threats.select("id", "severity", "source").join(actions.select(F.col("threat_id").alias("id"), "action_type"), "id", "left").join(n.withColumnRenamed("correlation_id", "id"), "id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def threat_report(threats: DataFrame, metrics: DataFrame, q: DataFrame) -> DataFrame:
    """One row: threats by severity, counters, held sources."""
    by = [F.coalesce(F.sum(F.when(F.col("severity") == s, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(s.lower()) for s in S.SEVERITY]
    return threats.agg(F.count(F.lit(1)).alias("n_threats"), *by).join(F.broadcast(metrics)).join(F.broadcast(q.agg(F.count(F.lit(1)).alias("held"))))


def gate_audit(calls: DataFrame, enforced: bool = True) -> DataFrame:
    """Decision of the method gate for each call: public, token and local callers pass; others are rejected or noted."""
    local = F.col("origin").isin("Unix", "Loopback")
    decision = F.when(S.classify_method(F.col("method")) == "public", "allow").when(S.has_token(F.col("params")), "allow").when(local, "allow").otherwise("reject" if enforced else "allow-audit")
    return calls.withColumns({"access": S.classify_method(F.col("method")), "decision": decision})


def threat_breakdown(threats: DataFrame) -> DataFrame:
    return threats.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def detection_quality(threats: DataFrame, feedback: DataFrame) -> DataFrame:
    """feedback (threat_id, false_positive, occurred_at): share of false positives and mean delay in seconds."""
    j = threats.select("id", "detected_at").join(feedback.select(F.col("threat_id").alias("id"), "false_positive", "occurred_at"), "id", "left")
    delay = (F.unix_micros(F.col("detected_at").cast("timestamp")) - F.unix_micros(F.col("occurred_at").cast("timestamp"))) / 1_000_000
    return j.agg(F.count(F.lit(1)).alias("n_threats"), F.avg(F.col("false_positive").cast("int")).alias("false_positive_rate"), F.avg(delay).alias("mean_delay_s"))


def shareable(threats: DataFrame) -> DataFrame:
    """What may leave the node: a hash, severity, type and time."""
    return threats.select(F.sha2(F.concat_ws("|", "category", "severity", "description"), 256).alias("fingerprint"), "severity", F.col("category").alias("threat_type"), "detected_at")


def exposition(metrics: DataFrame, prefix: str = "palisade") -> DataFrame:
    """Counter rows as lines of the text exposition format."""
    names = [c for c in metrics.columns if c != "last_updated"]
    long = metrics.select(*names).unpivot([], names, "metric", "value")
    return long.select(F.concat(F.lit(prefix + "_"), "metric", F.lit("_total "), F.col("value").cast("string")).alias("value"))
