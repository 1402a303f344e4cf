"""Registered queries that run as streams (to the end of what is there) or write and read files."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.operators import audit as A
from palisade.operators import observations as O
from palisade.plans.protocols import FileSink
from palisade.plans.scratch import folder, save
from palisade.sources import adapters as T
from palisade.sources import io, retention
from palisade.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State partitions of a registered stream, or as many as there are cores: each holds a Python process while it runs. A
#: checkpoint keeps the number that it began with. A job of your own sets its own.
STATE_PARTITIONS = 8


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the time of a query."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def as_stream(df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of files, in which ts is a timestamp."""
    spark = df.sparkSession
    if "ts" in df.columns:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there since the checkpoint."""
    with settings(stream.sparkSession, **{"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(max(STATE_PARTITIONS, stream.sparkSession.sparkContext.defaultParallelism))}):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def to_end(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark = stream.sparkSession
    out = folder(spark, "out")
    run(stream, out, folder(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def s3_stream_log_tail(spark, d):
    """Log lines that arrive as files, parsed as a stream."""
    from palisade.queries import json_lines

    path = folder(spark, "lines")
    json_lines(spark, d).select("value").write.text(path)
    out = to_end(io.stream_access_log(spark, path))
    return ntz(out, "ts").select("source", "uri", "status", "size", "ts")


def _write_logs(path: str, grown: bool):
    """A task's lines (part, value; in order) as log files. At first those of part 0 and the beginning of another line; when
    grown, those of part 1 as well, and every second file is rotated: part 2 stands in a new file of its name."""
    def write(batches):
        from pyspark import TaskContext

        from palisade.sources.tail import _open

        me = TaskContext.get().partitionId()
        system, root = _open(path)
        system.create_dir(root, recursive=True)
        rotated = grown and me % 2
        older = system.open_output_stream(f"{root}/{me}.log.1" if rotated else f"{root}/{me}.log")
        newer = system.open_output_stream(f"{root}/{me}.log") if rotated else older
        with older, newer:
            for batch in batches:
                for part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if part == 0 or grown:
                        (newer if part == 2 else older).write(f"{value}\n".encode())
            if not grown:
                older.write(b'{"request": {"remote')
        yield from ()

    return write


def s3_tail_growing_logs(spark, d):
    """Log files that grow, and are rotated, between two runs of a stream that follows them by byte position."""
    from palisade.queries import json_lines

    path, out, checkpoint = folder(spark, "logs"), folder(spark, "out"), folder(spark, "checkpoint")
    lines = save(json_lines(spark, d).select(F.pmod(F.hash("value"), F.lit(3)).alias("part"), "value").repartition(STATE_PARTITIONS), "lines").sortWithinPartitions("part", "value")
    stream = io.tail_access_log(spark, path, 1 << 16)
    for grown in (False, True):
        lines.mapInArrow(_write_logs(path, grown), "part int").count()
        run(stream, out, checkpoint)
    return ntz(spark.read.schema(stream.schema).parquet(out), "ts").select("source", "uri", "status", "size", "ts")


def s7_forward_audit(spark, d):
    """Audit events of Warn and above to two sinks; the rows of both."""
    audit = as_stream(A.with_seq(T.audit_events(spark, d), "ts", "event_id"), "audit")
    a, b = FileSink(folder(spark, "a")), FileSink(folder(spark, "b"))
    jobs.forward_audit(audit, a.publish, b.publish, folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    one = spark.read.parquet(a.path).select(F.lit("provenance").alias("sink"), "seq", "severity")
    return one.unionByName(spark.read.parquet(b.path).select(F.lit("attestation").alias("sink"), "anchor.seq", "anchor.severity"))


def t1_t2_stream_windows(spark, d):
    """Daily windows; the last ones stay open behind the watermark."""
    out = to_end(jobs.stream_observations(as_stream(T.access_log(spark, d), "log"), "1 day", "1 hour"))
    return ntz(out, "ts").select("source", "ts", "traffic_volume", "path_diversity", "method_diversity", F.round("error_rate_4xx", 6).alias("error_rate_4xx"))


def t3_stream_flush(spark, d):
    """Daily windows of a stream that ends: those behind the watermark, then the open ones. All windows of the log."""
    log = T.access_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path, end, out, checkpoint = (folder(spark, n) for n in ("log", "end", "out", "checkpoint"))
    log.write.parquet(path)
    rows = spark.readStream.schema(log.schema).parquet(path).unionByName(jobs.closing_rows(spark, log.schema, end))
    stream = jobs.stream_observations(rows, "1 day", "1 hour")
    run(stream, out, checkpoint)
    jobs.end_of_stream(spark, log.schema, end)
    run(stream, out, checkpoint)
    return ntz(spark.read.schema(stream.schema).parquet(out), "ts").withColumn("ports_accessed", F.array_join(F.col("ports_accessed").cast("array<string>"), ","))


def _late_days(spark, d):
    """Days before the 10th arrive after the end of the month, and are late."""
    log = T.access_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path, checkpoint, split = folder(spark, "log"), folder(spark, "checkpoint"), jobs.LateRows(folder(spark, "split"), "1 day", "1 hour")
    for when in ("ts >= '2024-01-10'", "ts < '2024-01-10'"):
        log.where(when).write.mode("append").parquet(path)
        split.writer(spark.readStream.schema(log.schema).parquet(path), checkpoint).trigger(availableNow=True).start().awaitTermination()
        yield log.schema, split


def t2_late_rows(spark, d):
    """Late rows themselves, with the number of late rows and of all rows of their batch."""
    for schema, split in _late_days(spark, d):
        pass
    counts = split.counts(spark).select("batch", "n", F.col("late").alias("n_late"))
    return ntz(split.late(spark, schema).join(F.broadcast(counts), "batch"), "ts").select("event_id", "source", "ts", "n", "n_late")


def t2_windows_in_time(spark, d):
    """Daily windows of the rows in time: the late ones change none, and none is dropped."""
    out, checkpoint = folder(spark, "out"), folder(spark, "checkpoint")
    for schema, split in _late_days(spark, d):
        stream = jobs.stream_observations(split.on_time(spark, schema), "1 day", "1 hour")
        run(stream, out, checkpoint)
    return ntz(spark.read.schema(stream.schema).parquet(out), "ts").select("source", "ts", "traffic_volume", "path_diversity", "method_diversity")


def t4_stream_observations(spark, d):
    """Six dimensions of each source, scored against its rolling profile before they are learned."""
    from palisade.queries import TH, observed, rounded

    obs = as_stream(observed(spark, d), "observations")
    found = O.anomalies(to_end(jobs.stream_observation_scores(obs, TH)), TH)
    return rounded(ntz(found, "ts"), "observed", "mean", "std_dev", "deviation", "confidence")


def r7_stream_reset(spark, d):
    """All sources start from seeds; those below 10.0.0.5 are reset in the middle of the month, below 10.0.0.2 once more
    on the 22nd, and start from seeds again. Observations and resets come in two runs."""
    from palisade.queries import TH, observed

    obs = save(observed(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "observed")
    at = lambda below, day: obs.where(F.col("source") < below).select("source", F.lit(day).cast("timestamp").alias("reset_at")).distinct()
    resets = at("10.0.0.5", "2024-01-15").unionByName(at("10.0.0.2", "2024-01-22"))
    rows_in, resets_in, out, checkpoint = (folder(spark, n) for n in ("observations", "resets", "out", "checkpoint"))
    for now in ("{} < '2024-01-18'", "{} >= '2024-01-18'"):
        obs.where(now.format("ts")).write.mode("append").parquet(rows_in)
        resets.where(now.format("reset_at")).write.mode("append").parquet(resets_in)
        read = lambda schema, path: spark.readStream.schema(schema).parquet(path)
        stream = jobs.stream_observation_scores(read(obs.schema, rows_in), TH, resets=read(resets.schema, resets_in), seeded=obs.select("source"))
        run(stream, out, checkpoint)
    scored = ntz(spark.read.schema(stream.schema).parquet(out), "ts")
    return scored.select("source", "ts", F.col("_n").alias("n"), F.round("connection_rate_mean", 8).alias("rate_mean"), F.round("traffic_volume_std", 6).alias("volume_std"), F.round("port_diversity_mean", 8).alias("ports_mean"), F.round("path_diversity_mean", 8).alias("paths_mean"))


def t4_stream_profile(spark, d):
    e = T.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "value")
    p = to_end(jobs.stream_profile(as_stream(e, "values"), 100))
    return p.select(F.col("id").alias("event_id"), "n", F.round("mean", 8).alias("mean"), F.round("std_dev", 8).alias("std_dev"))


def t5_stream_connectivity(spark, d):
    p = to_end(jobs.stream_connectivity(as_stream(T.probes(spark, d), "probes")))
    return p.select(F.col("id").alias("event_id"), "channel", "probes", F.round("failure_rate", 6).alias("failure_rate"), "severity")


def t6_stream_counter_rate(spark, d):
    p = to_end(jobs.stream_counter_rate(as_stream(T.host_metrics(spark, d), "metrics")))
    return p.select(F.col("id").alias("event_id"), F.col("key").alias("host"), F.round("rate", 6).alias("rate"))


def t7_stream_quarantine(spark, d):
    p = to_end(jobs.stream_quarantine(as_stream(T.quarantine_changes(spark, d), "changes")))
    return p.select(F.col("id").alias("event_id"), "source", "was_held", "held")


def s6_quarantine_snapshot(spark, d):
    """The sources held at the end, written as a new version and loaded again."""
    from palisade.queries import held

    path = folder(spark, "snapshots")
    io.save_quarantine(held(spark, d).withColumn("started_at", F.col("started_at").cast("timestamp")), path)
    return ntz(io.load_quarantine(spark, path), "started_at")


def t7_merge_quarantine(spark, d):
    """Quarantine changes of a stream in two runs, merged into the snapshots; the newest one loaded again."""
    changes = T.quarantine_changes(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path, snapshots, checkpoint = folder(spark, "changes"), folder(spark, "snapshots"), folder(spark, "checkpoint")
    for when in ("ts < '2024-01-16'", "ts >= '2024-01-16'"):
        changes.where(when).write.mode("append").parquet(path)
        stream = spark.readStream.schema(changes.schema).parquet(path)
        jobs.merge_quarantine(stream, snapshots, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ntz(io.load_quarantine(spark, snapshots), "started_at").drop("reason")


def t10_partial_delivery(spark, d):
    """Audit events to two sinks, of which the second refuses every 50th at first. What each took, how often, and where the
    cursor stood before and after the rest was delivered."""
    audit = as_stream(A.with_seq(T.audit_events(spark, d), "ts", "event_id"), "audit")
    a, b, refuses = FileSink(folder(spark, "a")), FileSink(folder(spark, "b")), [True]

    def second(records: DataFrame, n: int) -> DataFrame:
        seq = F.col("anchor.seq")
        b.publish(records.where(seq % 50 != 0) if refuses else records, n)
        return records.select(seq.alias("seq"), (seq % 50 != 0 if refuses else F.lit(True)).alias("delivered"))

    def first(records: DataFrame, n: int) -> DataFrame:
        a.publish(records, n)
        return records.select("seq", F.lit(True).alias("delivered"))

    f = jobs.Forwarder(folder(spark, "forwarder"), first, second)
    f.writer(audit, folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    stopped = f.state(spark)["cursor"]
    refuses.clear()
    f.retry(spark, audit.schema)
    took = spark.read.parquet(a.path).select(F.lit("provenance").alias("sink"), "seq").unionByName(spark.read.parquet(b.path).select(F.lit("attestation").alias("sink"), "anchor.seq"))
    return took.groupBy("sink", "seq").agg(F.count(F.lit(1)).alias("n")).withColumns({"stopped": F.lit(stopped).cast("long"), "cursor": F.lit(f.state(spark)["cursor"]).cast("long")})


def t8_stream_session_ends(spark, d):
    """Ends of the users' sessions: twelve hours without an event."""
    e = T.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), "ts")
    return ntz(to_end(jobs.stream_session_ends(as_stream(e, "calls"), 12 * 3_600_000)), "ended_at")


def z11_stream_approvals(spark, d):
    """Each order asks for approval when it is placed; every fifth is denied a minute later, the others wait for the timer."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("threat_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    asked = o.withColumn("decision", F.lit(None).cast("string"))
    denied = o.where("id % 5 = 0").select("threat_id", "id", (F.col("ts") + F.make_dt_interval(mins=F.lit(1))).alias("ts"), F.lit("denied").alias("decision"))
    return ntz(to_end(jobs.stream_approvals(as_stream(asked.unionByName(denied), "approvals"))), "ts")


def z8_retention(spark, d):
    """Events in a store by day; old days dropped, then the rows of the last two days and how many the store still has."""
    path = folder(spark, "store")
    e = T.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    retention.append(e, path)
    now = F.lit(e.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp_ntz")
    retention.drop_expired(spark, path, now, 48)
    left = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"))
    return retention.recent(spark, path, now, 48).select("event_id").join(F.broadcast(left))


def z15_export(spark, d):
    path = folder(spark, "export")
    e = T.table(spark, d, "events").select("event_id", "event_type", "value")
    io.export(e, "csv", path)
    return spark.read.schema(e.schema).option("header", "true").csv(path)


QUERIES = {f.__name__: f for f in (r7_stream_reset, s3_stream_log_tail, s3_tail_growing_logs, s6_quarantine_snapshot, s7_forward_audit, t1_t2_stream_windows, t2_late_rows, t2_windows_in_time, t3_stream_flush, t4_stream_observations, t4_stream_profile, t5_stream_connectivity, t6_stream_counter_rate, t7_merge_quarantine, t7_stream_quarantine, t8_stream_session_ends, t10_partial_delivery, z8_retention, z11_stream_approvals, z15_export)}
