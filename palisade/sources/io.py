"""Readers and writers: access logs, observations, threats, samples, snapshots and exports."""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import schemas
from palisade.functions import scalars as S
from palisade.sources.tail import Tail


def parse_log(lines: DataFrame) -> DataFrame:
    """Text lines (value) with the parsed entry, null where the line is not a valid entry."""
    e = F.from_json("value", schemas.ACCESS_LOG_JSON)
    ok = e["request"]["remote_ip"].isNotNull() & e["status"].isNotNull() & e["ts"].isNotNull() & e["status"].between(0, 65535) & (F.coalesce(e["size"], F.lit(0)) >= 0)
    return lines.where(F.trim("value") != "").withColumn("entry", F.when(ok, e))


def entries(parsed: DataFrame) -> DataFrame:
    """Flat rows with the defaults of missing fields."""
    r = F.col("entry.request")
    d = parsed.where("entry is not null")
    text = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return d.select(r["remote_ip"].alias("source"), text(r["host"], "host"), text(r["uri"], "uri"), text(r["method"], "method"), F.col("entry.status").alias("status"), F.coalesce("entry.size", F.lit(0)).cast("bigint").alias("size"), F.coalesce("entry.duration", F.lit(0.0)).alias("duration"), S.epoch_to_ts(F.col("entry.ts")).alias("ts"))


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return entries(parse_log(spark.read.text(path)))


def split_malformed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, bad lines); blank lines are in neither."""
    p = parse_log(lines)
    return entries(p), p.where("entry is null").select("value")


def stream_access_log(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Log files that appear in a folder, each once; the checkpoint of the query is the cursor. Rotate files into the folder."""
    return entries(parse_log(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)))


def tail_access_log(spark: SparkSession, folder: str, range_bytes: int = 32 << 20) -> DataFrame:
    """Log files that grow and are rotated in a folder: every whole line once, also over restarts with the same checkpoint,
    whose offsets are byte positions. Rotate within the folder."""
    spark.dataSource.register(Tail)
    return entries(parse_log(spark.readStream.format("log_tail").option("path", folder).option("range_bytes", range_bytes).load()))


def union_sources(**sources: DataFrame) -> DataFrame:
    """Entries of several log sources with their origin; missing columns are null."""
    frames = [d.withColumn("origin", F.lit(name)) for name, d in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _time(c):
    return F.timestamp_micros(c["secs_since_epoch"] * 1_000_000 + F.floor(c["nanos_since_epoch"] / 1000))


def _epoch(c):
    micros = F.unix_micros(c)
    return F.struct(F.floor(micros / 1_000_000).cast("bigint").alias("secs_since_epoch"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("bigint").alias("nanos_since_epoch"))


def observations_from_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, bad lines). Rate, volume, ports and time are required; a negative volume is bad."""
    o = F.from_json("value", schemas.OBSERVATION_JSON)
    ok = o["connection_rate"].isNotNull() & (o["traffic_volume"] >= 0) & o["ports_accessed"].isNotNull() & ~F.exists(F.coalesce(o["ports_accessed"], F.array().cast("array<int>")), lambda p: p.isNull() | ~p.between(0, 65535)) & o["timestamp"]["secs_since_epoch"].isNotNull()
    p = lines.withColumn("o", F.when(F.coalesce(ok, F.lit(False)), o))
    good = p.where("o is not null").select("o.source", "o.connection_rate", "o.traffic_volume", "o.ports_accessed", _time(F.col("o.timestamp")).alias("ts"), "o.http")
    return good, p.where("o is null").select("value")


def observations_to_json(obs: DataFrame) -> DataFrame:
    """One JSON text (value) a row; http is left out where it is null."""
    return obs.select(F.to_json(F.struct("source", "connection_rate", "traffic_volume", "ports_accessed", _epoch(F.col("ts").cast("timestamp")).alias("timestamp"), "http"), {"ignoreNullFields": "true"}).alias("value"))


def threats_from_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threats, bad lines). The kind is the one key of threat_type; a record with none, or with two, is bad."""
    t = F.from_json("value", schemas.THREAT_JSON)
    kinds = [f.name for f in schemas.struct(schemas.THREAT_DETAIL).fields]
    n = sum((t["threat_type"][k].isNotNull().cast("int") for k in kinds), F.lit(0))
    ok = t["id"].isNotNull() & t["severity"].isin(*S.SEVERITY) & t["confidence"].isNotNull() & t["source"].isNotNull() & t["detected_at"]["secs_since_epoch"].isNotNull() & (n == 1)
    p = lines.withColumn("t", F.when(F.coalesce(ok, F.lit(False)), t))
    kind = F.coalesce(*[F.when(F.col(f"t.threat_type.{k}").isNotNull(), k) for k in kinds])
    good = p.where("t is not null").select("t.id", kind.alias("category"), "t.severity", S.rank_of(F.col("t.severity"), S.SEVERITY).alias("severity_rank"), "t.source", "t.target", _time(F.col("t.detected_at")).alias("detected_at"), "t.description", "t.confidence", F.col("t.threat_type").alias("detail"))
    return good, p.where("t is null").select("value")


def read_host_metrics(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schemas.HOST_METRICS).format(fmt).load(path)


# --- quarantine snapshots: a new version folder each time, and a pointer table of versions --------

def save_quarantine(q: DataFrame, path: str) -> str:
    """Write a new version; the one being read is never overwritten. The pointer is written last and names the time of
    writing, so of two writers the later one counts."""
    spark, version = q.sparkSession, uuid.uuid4().hex
    q.select("source", "started_at", "reason", "threat_id").write.parquet(f"{path}/versions/{version}")
    spark.createDataFrame([(time.time_ns(), version)], VERSIONS).coalesce(1).write.mode("append").json(f"{path}/pointer")
    return version


VERSIONS = "at long, version string"


def current_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; an empty table before the first one. One that is named but cannot be read raises."""
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.schema(VERSIONS).json(f"{path}/pointer").orderBy(F.desc("at"), "version").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return spark.createDataFrame([], schemas.QUARANTINE)
    return spark.read.schema(schemas.QUARANTINE).parquet(f"{path}/versions/{last['version']}")


def load_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The newest version, or an empty table if there is none or it cannot be read (a warning is logged then)."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        q = current_quarantine(spark, path)
        q.agg(*[F.count(c) for c in q.columns]).first()  # every column can be read
        return q
    except (PySparkException, Py4JJavaError) as e:
        logging.getLogger(__name__).warning("quarantine at %s cannot be read, starting empty: %s", path, str(e).split("\n")[0])
        return spark.createDataFrame([], schemas.QUARANTINE)


def export(df: DataFrame, fmt: str, path: str) -> None:
    """JSON or CSV with a header."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    df.write.format(fmt).option("header", "true").save(path)


# --- audit forwarding ------------------------------------------------------------------------------

def provenance_records(audit: DataFrame) -> DataFrame:
    return audit.select(F.lit("security_audit").alias("event_type"), "seq", F.col("ts").alias("timestamp"), "severity", F.col("source").alias("event_source"), F.to_json(F.struct("kind", "subject", "detail")).alias("payload"), "correlation_id")


def attestation_records(audit: DataFrame) -> DataFrame:
    return audit.select(F.lit("security_attestation").alias("record_type"), F.struct("seq", F.col("ts").alias("timestamp"), "source", "severity").alias("anchor"), F.to_json(F.struct("kind", "subject", "detail")).alias("payload"), "correlation_id")
