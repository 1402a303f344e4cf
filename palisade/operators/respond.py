"""Graduated response: decisions, quarantine state and its history, advisory verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.operators import observations as O
from palisade.plans.ordered import carried
from palisade.thresholds import DEFAULTS, Thresholds


def decide(severity: Column, confidence: Column, th: Thresholds = DEFAULTS, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit("MonitorAndAlert")
    return F.when((severity == "Critical") & (confidence > th.quarantine_critical_confidence), "Quarantine").when((severity == "High") & (confidence > th.quarantine_high_confidence), "QuarantineAndAlert").otherwise("MonitorAndAlert")


def evaluate(threats: DataFrame, th: Thresholds = DEFAULTS, enabled: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One action for each threat; monitoring needs approval. The threat columns named in `keep` come along, so that
    actions need not be joined to their threats again."""
    action = decide(F.col("severity"), F.col("confidence"), th, enabled)
    return threats.select(F.col("id").alias("threat_id"), action.alias("action_type"), F.col("source").alias("target"), (action == "MonitorAndAlert").alias("requires_approval"), F.concat_ws(" ", F.col("severity"), F.col("category")).alias("reason"), F.col("detected_at").alias("decided_at"), *keep)


def apply_actions(actions: DataFrame, quarantine: DataFrame, auto: bool = True) -> DataFrame:
    """The quarantine table after the actions: the last one of a source wins. Without auto response nothing changes."""
    if not auto:
        return quarantine
    new = actions.where(F.col("action_type").isin("Quarantine", "QuarantineAndAlert")).select(F.col("target").alias("source"), F.col("decided_at").alias("started_at"), "reason", "threat_id")
    return upsert(quarantine, new)


def upsert(quarantine: DataFrame, new: DataFrame) -> DataFrame:
    new = O.latest(new, "source", ("started_at", "threat_id"))
    return quarantine.join(new.select("source"), "source", "left_anti").unionByName(new)


def quarantine(q: DataFrame, requests: DataFrame) -> DataFrame:
    """Manual entries; an empty source is refused."""
    r = requests.where("source is not null and source <> ''").select("source", "started_at", F.coalesce("reason", F.lit("manual quarantine")).alias("reason"), F.coalesce("threat_id", F.lit("manual")).alias("threat_id"))
    return upsert(q, r)


def release(q: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quarantine without the released, requests with whether there was anything to release)."""
    names = requests.select("source").distinct()
    hit = q.select("source").distinct().withColumn("released", F.lit(True))
    return q.join(names, "source", "left_anti"), names.join(hit, "source", "left").withColumn("released", F.coalesce("released", F.lit(False)))


def with_quarantine(df: DataFrame, q: DataFrame) -> DataFrame:
    """df plus quarantined and threat_id; one row a source in q. The optimizer broadcasts q if it is small."""
    return df.join(q.select("source", "threat_id", F.lit(True).alias("quarantined")), "source", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))


def drop_quarantined(calls: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected): calls from quarantined hosts are rejected, health methods never are."""
    c = calls.withColumn("source", S.host_of(F.col("source_addr")))
    free = (F.col("method") == "health") | F.col("method").startswith("health.")
    j = c.join(q.select("source", F.lit(True).alias("_q")).distinct(), "source", "left").withColumn("_q", F.coalesce("_q", F.lit(False)) & ~free)
    return j.where(~F.col("_q")).drop("_q"), j.where("_q").drop("_q")


def quarantine_intervals(changes: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(source, start, end, threat_id) from enter and release rows: a new enter replaces the old, end is null if open.
    `order` begins with the time, the rest are numbers. Read from the end, the time of the next change is carried along,
    so one source may hold any number of changes."""
    d = changes.select("source", "op", "threat_id", F.col(order[0]).alias("start"), (-F.unix_micros(F.col(order[0]).cast("timestamp"))).alias("_o0"), *[(-F.col(c)).alias(f"_o{i + 1}") for i, c in enumerate(order[1:])])
    d = carried(d, ["source"], [f"_o{i}" for i in range(len(order))], F.col("start"), "end", inclusive=False)
    return d.where("op = 'enter'").select("source", "start", "end", "threat_id")


def quarantined_at(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """df plus whether its source was in quarantine at ts, and by which threat. Intervals of a source do not overlap,
    except that one may start in the instant in which another ends; it then has no length and never matches.

    An as-of join without a join: events and intervals in one order, the last interval carried along its source."""
    kind = df.schema["ts"].dataType
    of = lambda row, source, ts, nth, q: (row.alias("_row"), source.alias("_s"), ts.cast(kind).alias("_t"), nth.alias("_nth"), q.alias("_q"))
    held = F.struct(F.col("end").cast(kind).alias("end"), "threat_id")
    i = intervals.where("source is not null").select(*of(F.lit(None), F.col("source"), F.col("start"), F.when(F.col("end") <= F.col("start"), 0).otherwise(1), held))
    rows = df.select(*of(F.struct(*df.columns), F.col("source"), F.col("ts"), F.lit(2), F.lit(None)))
    c = carried(i.unionByName(rows), ["_s"], ["_t", "_nth"], F.col("_q"), "_held").where(F.col("_row").isNotNull())
    hit = F.coalesce(F.col("_held").isNotNull() & F.col("_t").isNotNull() & (F.col("_held.end").isNull() | (F.col("_t") < F.col("_held.end"))), F.lit(False))
    return c.select("_row.*", F.when(hit, F.col("_held.threat_id")).alias("q_threat"), hit.alias("quarantined"))


def defense_status(q: DataFrame, enabled: bool = True, auto_response: bool = True) -> DataFrame:
    """One row for each held source (source, reason, threat_id, started_at), each with whether the engine is enabled and
    responds by itself, and how many sources are held; one row without a source if there are none. A table of any size
    stays distributed: the count is a table of one row."""
    n = q.agg(F.count(F.lit(1)).alias("quarantined_count"))
    state = n.select(F.lit(enabled).alias("enabled"), F.lit(auto_response).alias("auto_response"), "quarantined_count")
    entries = q.select("source", "reason", "threat_id", "started_at").join(F.broadcast(state))
    none = state.where("quarantined_count = 0").select(*[F.lit(None).cast(q.schema[c].dataType).alias(c) for c in ("source", "reason", "threat_id", "started_at")], *state.columns)
    return entries.unionByName(none)


def defense_summary(q: DataFrame) -> DataFrame:
    """One row: how many sources are held, and since when."""
    return q.agg(F.count(F.lit(1)).alias("quarantined"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))


def advise(requests: DataFrame, q: DataFrame, stats: DataFrame, th: Thresholds = DEFAULTS, enabled: bool = True) -> DataFrame:
    """One verdict for each request (source, ts and HTTP dimensions): block, warn with anomalies, or allow."""
    found = O.http_anomalies(O.score_against(requests, stats, th)).groupBy("source", "ts").agg(F.array_sort(F.collect_list("dimension")).alias("anomalies"))
    r = with_quarantine(requests.select("source", "ts"), q).join(found, ["source", "ts"], "left")
    n = F.coalesce(F.size("anomalies"), F.lit(0)) if enabled else F.lit(0)
    warn = F.col("anomalies").isNotNull() & F.lit(enabled)
    held = F.col("quarantined")
    calm = "no threats detected for source" if enabled else "defense engine disabled, no advisory"
    return r.select(
        "source", "ts", F.when(held, "block").when(warn, "warn").otherwise("allow").alias("verdict"),
        F.when(held, "source is quarantined").when(warn, S.advisory_reason(n)).otherwise(calm).alias("reason"),
        F.when(held, F.array("threat_id")).otherwise(F.array().cast("array<string>")).alias("threat_ids"),
        F.when(~held & warn, F.col("anomalies")).otherwise(F.array().cast("array<string>")).alias("anomalies"))


# fixed values: packets a second by severity, and hours an action lasts
RATE_LIMIT = {"Low": 1000, "Medium": 100, "High": 10, "Critical": 1}
HOURS = {"Quarantine": 1, "QuarantineAndAlert": 1, "Block": 24}


def response_plan(actions: DataFrame, threats: DataFrame) -> DataFrame:
    """Rate limit by the threat's severity and the time at which the action expires (null: it does not)."""
    j = actions.join(threats.select(F.col("id").alias("threat_id"), "severity"), "threat_id")
    limit = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in RATE_LIMIT.items()])
    ends = F.coalesce(*[F.when(F.col("action_type") == k, F.col("decided_at") + F.expr(f"interval {h} hours")) for k, h in HOURS.items()])
    return j.select("threat_id", "action_type", "target", limit.alias("packets_per_second"), ends.alias("expires_at"))


def resolve_approvals(pending: DataFrame, decisions: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Status of each pending action: the decision if there is one, approved by timeout after `minutes`, else pending."""
    j = pending.join(O.latest(decisions, "threat_id", ("decided_at",)).select("threat_id", "decision"), "threat_id", "left")
    late = F.col("requested_at") + F.expr(f"interval {minutes} minutes") <= now
    return j.withColumn("status", F.coalesce("decision", F.when(late, "auto-approved").otherwise("pending")))
