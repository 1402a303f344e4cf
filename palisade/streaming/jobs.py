"""The same rules as streams."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from palisade.functions import scalars as S
from palisade.operators import audit as A
from palisade.operators import observations as O
from palisade.operators.observations import seconds_of
from palisade.sources import io
from palisade.thresholds import DEFAULTS, Thresholds


def stream_observations(log: DataFrame, window: str = "60 seconds", delay: str = "60 seconds", exact: bool = True) -> DataFrame:
    """Tumbling windows of each source; rows later than `delay` behind the watermark are dropped.

    Streams allow no exact distinct count, so windows are grouped twice: by each path, method and port first (a row of state
    for each, whatever its number, spread over all tasks), then counted. exact=False counts paths approximately, in one
    grouping. A watermark never closes the last windows: with an availableNow trigger they come with the next run, or, at the
    end of a stream, by closing_rows(). LateRows keeps what came too late.
    """
    sec, log = float(seconds_of(window)), log.withWatermark("ts", delay)
    uri, method, port = F.nullif(F.col("uri"), F.lit("")), F.nullif(F.col("method"), F.lit("")), S.port_of(F.col("host"))
    status = S.status_class(F.col("status"))
    measured = {"n": F.count(F.lit(1)), "total": F.sum("size"), "c4": F.sum(F.when(status == "4xx", 1).otherwise(0)), "c5": F.sum(F.when(status == "5xx", 1).otherwise(0))}
    if exact:
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("item")) for k, v in (("uri", uri), ("method", method), ("port", port))])
        rows = log.select("source", "ts", "size", "status", F.inline(kinds))
        once = rows.groupBy("source", F.window("ts", window).alias("w"), "kind", "item").agg(*[c.alias(k) for k, c in measured.items()])
        one = F.col("kind") == "uri"
        distinct = lambda kind: F.sum(F.when((F.col("kind") == kind) & F.col("item").isNotNull(), 1).otherwise(0))
        g = once.groupBy("source", F.window("w", window).alias("w")).agg(
            *[F.sum(F.when(one, F.col(k))).alias(k) for k in measured], distinct("uri").alias("paths"), distinct("method").alias("methods"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "port", F.col("item").cast("int")))).alias("ports_accessed"))
    else:
        g = log.groupBy("source", F.window("ts", window).alias("w")).agg(
            *[c.alias(k) for k, c in measured.items()], F.approx_count_distinct(uri).alias("paths"), F.size(F.collect_set(method)).alias("methods"), F.array_sort(F.collect_set(port)).alias("ports_accessed"))
    n, total = F.col("n"), F.col("total")
    return g.select("source", (n / sec).alias("connection_rate"), F.floor(total / sec).cast("bigint").alias("traffic_volume"), "ports_accessed", (n / sec).alias("request_rate"),
                    (F.col("c4") / n).alias("error_rate_4xx"), (F.col("c5") / n).alias("error_rate_5xx"), F.col("paths").cast("int").alias("path_diversity"), F.floor(total / n).cast("bigint").alias("avg_payload_bytes"),
                    F.least("methods", F.lit(255)).cast("int").alias("method_diversity"), F.col("w.start").alias("ts"))


#: Date of the row that ends a stream.
END = "2200-01-01"


def closing_rows(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """A stream of a folder of its own, empty at first, to be united with the stream that end_of_stream() is to end."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def end_of_stream(spark: SparkSession, schema: StructType, path: str, ts: str = "ts") -> None:
    """Add the last row of a stream to the folder of its closing_rows(). It is dated after everything else, so the next run
    closes all open windows; its own window never closes, and rows that come after it are late."""
    row = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).write.mode("append").parquet(path)


class LateRows:
    """Divides the rows of a stream into those in time and those whose window was over, and keeps both below `path`.

    A row is late if its window of `window` ends at or before the greatest ts of all earlier batches less `delay`; that mark
    and the number of rows are committed once a batch is written. Each batch is read once, without a shuffle. A batch that
    comes again after a failure is judged by the same mark and replaces its files; one that was committed is left alone.
    Rows without ts are in time (they are in no window).

    Read on_time() as the stream that windows are made of, with the same window and delay: they drop nothing then. Let its
    runs follow those of writer(), not go on beside them, so that it sees whole batches. The batch tables late() and counts()
    can be read at any time.
    """

    STATE = "batch long, mark long, n long, late long"
    #: The partition column of the files: true holds late rows.
    LATE = "_late"

    def __init__(self, path: str, window: str, delay: str):
        self.path, self.window_us, self.delay_us = path, seconds_of(window) * 1_000_000, seconds_of(delay) * 1_000_000

    def counts(self, spark: SparkSession) -> DataFrame:
        """(batch, mark, n, late): rows of each batch, late ones, and the mark in microseconds that the next ones are held to."""
        try:
            return spark.read.schema(self.STATE).json(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.STATE)

    def divide(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = self.counts(spark).agg(F.max("mark").alias("mark"), F.max("batch").alias("batch")).first()
        if old["batch"] is not None and batch_id <= old["batch"]:
            return
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        end = us - F.pmod(us, F.lit(self.window_us)) + self.window_us
        late = F.coalesce(end <= F.lit(old["mark"]), F.lit(False))
        seen = Observation()
        rows = batch.withColumn(self.LATE, late).observe(seen, F.max(us).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(self.LATE).alias("late"))
        rows.write.mode("overwrite").partitionBy(self.LATE).parquet(f"{self.path}/rows/batch={batch_id}")
        got = seen.get
        marks = [m for m in (old["mark"], None if got["last"] is None else got["last"] - self.delay_us) if m is not None]
        spark.createDataFrame([(batch_id, max(marks, default=None), got["n"], got["late"])], self.STATE).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def writer(self, stream: DataFrame, checkpoint: str):
        """The writer that divides a stream with a column ts; call start()."""
        return stream.writeStream.foreachBatch(self.divide).option("checkpointLocation", checkpoint)

    def on_time(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """A stream of the rows in time."""
        return spark.readStream.schema(schema).parquet(f"{self.path}/rows/batch=*/{self.LATE}=false")

    def late(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The late rows so far, with the number of the batch that brought them."""
        full = StructType([*schema.fields, StructField("batch", LongType()), StructField(self.LATE, BooleanType())])
        try:
            rows = spark.read.schema(full).parquet(f"{self.path}/rows")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], full)
        return rows.where(self.LATE).drop(self.LATE).join(self.counts(spark).select("batch"), "batch", "left_semi")


def over_windows(values: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, spread) of the n[i] rows of `values` before the ends[i]-th, column by column; NaN is no value. Windows are taken
    in order of their length, so a block of them is as wide as its longest."""
    mean, std = np.full((len(n), values.shape[1]), np.nan), np.full((len(n), values.shape[1]), np.nan)
    order = np.argsort(n, kind="stable")
    for at in range(0, len(order), 2048):
        i = order[at: at + 2048]
        back = np.arange(n[i[-1]])
        if not len(back):
            continue
        inside = back < n[i, None]
        view = values[np.where(inside, ends[i, None] - 1 - back, 0)]
        view[~inside] = np.nan
        seen = ~np.isnan(view)
        count = seen.sum(axis=1)
        with np.errstate(invalid="ignore"):  # windows without any value
            mean[i] = np.where(seen, view, 0.0).sum(axis=1) / count
            off = np.where(seen, view - mean[i][:, None], 0.0)
            spread = np.sqrt((off * off).sum(axis=1) / count)
        spread[np.fmin.reduce(view, axis=1) == np.fmax.reduce(view, axis=1)] = 0.0
        std[i] = spread
    return mean, std


def over_ring(ring: np.ndarray, rows: np.ndarray, size: int, include_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, spread) of the last `size` rows before each of `rows` (with itself, if include_self), column by column.
    `ring` holds the rows before the first."""
    ends = np.arange(len(rows)) + len(ring) + include_self
    n = np.minimum(ends, size)
    return n, *over_windows(np.concatenate([ring, rows]), ends, n)


#: Buckets of keys of a stateful stream: one call into Python handles a bucket of a micro-batch, not a key, so their number
#: times some milliseconds is what a batch costs besides its rows. A checkpoint keeps the number that it began with.
BUCKETS = 256


def bucketed(d: DataFrame, key: str, buckets: int):
    """Rows grouped by the bucket of their key."""
    return d.withColumn("bucket", F.pmod(F.hash(F.col(key)), F.lit(buckets))).groupBy("bucket")


def by_key(rows: Iterator[pd.DataFrame], key: str) -> tuple[pd.DataFrame, list[tuple[str, int, int]]]:
    """A bucket's rows of one micro-batch, key by key in order of time (resets after other rows of their time) and id, and
    (key, from, to) of each. A batch is bounded by the source's rate options."""
    frames = list(rows)
    if not frames:
        return pd.DataFrame(), []
    d = pd.concat(frames, ignore_index=True)
    codes, names = pd.factorize(d[key], use_na_sentinel=False)
    d = d.assign(_key=codes).sort_values(["_key", "ts", *(c for c in ("reset",) if c in d), "id"], ignore_index=True)
    starts = np.flatnonzero(np.diff(d["_key"].to_numpy(), prepend=-1)).tolist()
    return d, [(names[d["_key"].iat[a]], a, b) for a, b in zip(starts, [*starts[1:], len(d)], strict=True)]


class Ring(StatefulProcessor):
    """Mean, spread and count of the last `size` rows of a key for each of `dims`, judged with or before their learning. A row
    marked as a reset leaves nothing of what was learned but `seed`, and is no value itself. The state of a bucket is a map
    from its keys to their rows (as bytes), of which only those of the batch's keys are touched, and none is read before there
    is any. All keys of a bucket are judged in one pass over arrays."""

    def __init__(self, size: int, include_self: bool, dims: tuple[str, ...], seed: np.ndarray | None = None):
        self.size, self.include_self, self.dims = size, include_self, dims
        self.seed = np.zeros((0, len(dims))) if seed is None else seed[-size:]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getMapState("rings", "key string", "v binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, learned in zip(initialState["key"], initialState["learned"], strict=True):
            self.rings.updateValue((name,), (np.asarray(learned, float).tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d, parts = by_key(rows, "key")
        if not parts:
            return
        new, resets = d[list(self.dims)].to_numpy(float), d["reset"].to_numpy(bool)
        some, cuts = self.rings.exists(), resets.any()
        pieces, runs, at = [], [], 0  # what keys knew and learn, one after another; rows that learn without a reset between
        for name, first, end in parts:
            known = self.rings.getValue((name,)) if some else None
            kept = np.zeros((0, len(self.dims))) if known is None else np.frombuffer(known[0]).reshape(-1, len(self.dims))
            for a, b in pairwise([first, *((first + np.flatnonzero(resets[first:end])).tolist() if cuts else ()), end]):
                if a < b and resets[a]:
                    kept, a = self.seed, a + 1
                if a < b:
                    runs.append((a, b - a, len(kept), at))
                    pieces += [kept, new[a:b]]
                    at += len(kept) + b - a
                    kept = np.concatenate([kept, new[a:b]])[-self.size:]
            if len(kept):
                self.rings.updateValue((name,), (kept.tobytes(),))
            elif known is not None:
                self.rings.removeKey((name,))
        n, mean, std = np.zeros(len(d), np.int32), np.empty(new.shape), np.empty(new.shape)
        if runs:
            first, length, before, at = np.array(runs).T
            nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            row, past = np.repeat(first, length) + nth, np.repeat(before, length) + nth + self.include_self
            n[row] = np.minimum(past, self.size)
            mean[row], std[row] = over_windows(np.concatenate(pieces), np.repeat(at, length) + past, n[row])
        out = {"key": d["key"], "id": d["id"], "ts": d["ts"], "n": n}
        for k, c in enumerate(self.dims):
            out |= {c: new[:, k], f"{c}_mean": mean[:, k], f"{c}_std": std[:, k]}
        yield pd.DataFrame(out)[~resets]

    def close(self) -> None:
        pass


def stream_profiles(values: DataFrame, dims: tuple[str, ...], size: int, include_self: bool = True, initial: DataFrame | None = None, seed: np.ndarray | None = None, buckets: int = BUCKETS) -> DataFrame:
    """values (key, id, ts, dims) -> key, id, ts, n, and value, mean and spread of each dimension. Needs the RocksDB state
    store; the state of a key is its last `size` rows.

    `initial` (like values; no stream) is what keys have learned before the first batch. Where values have a column reset,
    rows in which it is true are no values: what the key learned up to their time is forgotten, and `seed` (rows of dims)
    stands in its place. Rows with an older time that come in a later batch than a reset are learned after it.
    """
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in values.columns else F.lit(False)
    cast = lambda d, *more: d.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), *more, *[F.col(k).cast("double").alias(k) for k in dims])
    out = "key string, id long, ts timestamp, n int, " + ", ".join(f"{k} double, {k}_mean double, {k}_std double" for k in dims)
    known = None
    if initial is not None:  # one row a key
        last = O.last_n(cast(initial), size, ["key"], ["ts", "id"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "id", F.array(*dims).alias("v")))).alias("rows"))
        known = bucketed(last.select("key", F.flatten("rows.v").alias("learned")), "key", buckets)
    return bucketed(cast(values, reset.alias("reset")), "key", buckets).transformWithStateInPandas(Ring(size, include_self, dims, seed), out, "Append", "None", known)


def stream_profile(values: DataFrame, size: int, include_self: bool = True) -> DataFrame:
    """The same of one value: key, id, ts, value, n, mean, std_dev."""
    p = stream_profiles(values, ("value",), size, include_self)
    return p.select("key", "id", "ts", "value", "n", F.col("value_mean").alias("mean"), F.col("value_std").alias("std_dev"))


def stream_score(values: DataFrame, th: Thresholds = DEFAULTS, include_self: bool = True) -> DataFrame:
    """The rolling profile with its z-score and whether it is an anomaly."""
    p = stream_profile(values, th.window, include_self)
    z = F.when(F.col("n") >= th.min_observations, S.z_score(F.col("value"), F.col("mean"), F.col("std_dev")))
    return p.withColumn("z", z).withColumn("anomalous", F.coalesce(S.exceeds(F.col("z"), th.sigma), F.lit(False)))


def stream_observation_scores(obs: DataFrame, th: Thresholds = DEFAULTS, include_self: bool = False, resets: DataFrame | None = None, seeded: DataFrame | None = None) -> DataFrame:
    """Observations of a stream, scored in all six dimensions against the rolling profile of their source, then learned.
    The rows are those of observations.rolling_score, so anomalies() and the detectors take them.

    resets (source, reset_at; a stream too): a source forgets what it learned up to then and starts from the ordinary
    observations of seed_observations. Sources of `seeded` (a table) start from those from the beginning."""
    d = O.with_dimensions(obs).select(F.col("source").alias("key"), F.lit(0).alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("reset"), *[F.col(k).cast("double").alias(k) for k in O.DIMENSIONS])
    seed = initial = None
    if resets is not None:
        at = resets.select(F.col("source").alias("key"), F.lit(0).alias("id"), F.col("reset_at").cast("timestamp").alias("ts"), F.lit(True).alias("reset"))
        d = d.unionByName(at, allowMissingColumns=True)
        ordinary = O.with_dimensions(O.seed_observations(obs.sparkSession, obs.sparkSession.createDataFrame([("",)], "source string"))).orderBy("ts")
        seed = np.array([[np.nan if v is None else float(v) for v in r] for r in ordinary.select(*O.DIMENSIONS).collect()])
    if seeded is not None:
        initial = O.with_dimensions(O.seed_observations(obs.sparkSession, seeded)).withColumns({"key": F.col("source"), "id": F.lit(0)})
    p = stream_profiles(d, O.DIMENSIONS, th.window, include_self, initial, seed).withColumnsRenamed({"key": "source", "n": "_n"}).drop("id")
    return O.with_z(p, th)


def stream_connectivity(probes: DataFrame, th: Thresholds = DEFAULTS, id_col: str = "event_id") -> DataFrame:
    """Failure rate of the last probes of each channel, where it is above the limit."""
    bad = F.when(F.col("success"), 0.0).otherwise(1.0)
    p = stream_profile(probes.select(F.col("channel").alias("key"), F.col(id_col).alias("id"), "ts", bad.alias("value")), th.failure_window)
    fired = p.where((F.col("n") >= th.failure_min_probes) & (F.round("mean", 9) > th.failure_rate))
    return fired.select(F.col("key").alias("channel"), "id", "ts", F.col("mean").alias("failure_rate"), F.col("n").alias("probes"), F.when(F.round("mean", 9) > th.failure_critical, "Critical").otherwise("High").alias("severity"))


class Previous(StatefulProcessor):
    """Increase per second since the previous sample of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "key string", "ts long, value double")

    def handleInputRows(self, key, rows, timerValues):
        d, parts = by_key(rows, "key")
        if not parts:
            return
        at, value = np.array(micros(d["ts"])), d["value"].to_numpy(float)
        at_before, before = np.roll(at, 1), np.roll(value, 1)
        for name, a, b in parts:
            last = self.last.getValue((name,))
            at_before[a], before[a] = (at[a], np.nan) if last is None else last
            self.last.updateValue((name,), (int(at[b - 1]), float(value[b - 1])))
        ok = (value >= before) & (at > at_before)
        rate = np.where(ok, (value - before) / np.where(ok, (at - at_before) / 1e6, 1.0), 0.0)
        yield pd.DataFrame({"key": d["key"], "id": d["id"], "ts": d["ts"], "rate": rate})

    def close(self) -> None:
        pass


def stream_counter_rate(metrics: DataFrame, id_col: str = "event_id", counter: str = "forks_total", buckets: int = BUCKETS) -> DataFrame:
    d = metrics.select(F.col("host").cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col(counter).cast("double").alias("value"))
    return bucketed(d, "key", buckets).transformWithStateInPandas(Previous(), "key string, id long, ts timestamp, rate double", "Append", "None")


class Held(StatefulProcessor):
    """Whether a source is in quarantine after each change; its state lives for a limited time."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.threat = handle.getMapState("threat", "source string", "threat_id string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        d, parts = by_key(rows, "source")
        if not parts:
            return
        held = (d["op"] == "enter").to_numpy(bool)
        was, threats = np.roll(held, 1), d["threat_id"].tolist()
        for name, a, b in parts:
            was[a] = self.threat.containsKey((name,))
            if held[b - 1]:
                self.threat.updateValue((name,), (threats[b - 1],))
            elif was[a]:
                self.threat.removeKey((name,))
        yield pd.DataFrame({"source": d["source"], "id": d["id"], "ts": d["ts"], "was_held": was, "held": held})

    def close(self) -> None:
        pass


def stream_quarantine(changes: DataFrame, id_col: str = "event_id", ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """changes (source, ts, op, threat_id) -> state before and after each."""
    d = changes.select("source", F.col(id_col).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "op", "threat_id")
    mode = "ProcessingTime" if ttl_ms else "None"
    return bucketed(d, "source", buckets).transformWithStateInPandas(Held(ttl_ms), "source string, id long, ts timestamp, was_held boolean, held boolean", "Append", mode)


def merge_quarantine(changes: DataFrame, path: str, checkpoint: str, id_col: str = "event_id", reason: str = "stream"):
    """changes (source, ts, op, threat_id) of a stream -> snapshots below path: each batch sets its sources' last state in the
    newest version and writes the next one. Batches count in the order of their arrival, changes of one batch in the order of
    ts and id. A batch that comes again sets the same states, so it changes nothing. If the newest version cannot be read the
    batch fails; nothing starts over from empty. Returns the writer; call start()."""
    d = changes.select("source", F.col(id_col).alias("id"), F.col("ts").cast("timestamp").alias("started_at"), "op", "threat_id").where("source is not null and op in ('enter', 'release')")

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = O.latest(batch, "source", ("started_at", "id"))
        before = io.current_quarantine(batch.sparkSession, path)
        entered = last.where("op = 'enter'").select("source", "started_at", F.lit(reason).alias("reason"), "threat_id")
        io.save_quarantine(before.join(last.select("source"), "source", "left_anti").unionByName(entered), path)

    return d.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


class Session(StatefulProcessor):
    """Whether a session is known at each of its calls; it is forgotten when its time to live is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "session_id string", "ts long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        d, parts = by_key(rows, "session_id")
        if not parts:
            return
        known, at = np.ones(len(d), bool), micros(d["ts"])
        for name, a, b in parts:
            known[a] = self.seen.containsKey((name,))
            self.seen.updateValue((name,), (at[b - 1],))
        yield pd.DataFrame({"session_id": d["session_id"], "id": d["id"], "ts": d["ts"], "known": known})

    def close(self) -> None:
        pass


def stream_sessions(calls: DataFrame, ttl_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """calls (session_id, id, ts) -> whether the session was known before each. State lives for ttl_ms of processing time
    after the last call. A stream whose state expires by the clock does not end by itself: run it with a processing-time
    trigger and stop it."""
    d = calls.select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return bucketed(d, "session_id", buckets).transformWithStateInPandas(Session(ttl_ms), "session_id string, id long, ts timestamp, known boolean", "Append", "ProcessingTime")


def micros(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[ns]").astype("int64") // 1000).tolist()


def _moments(us: list[int]) -> pd.Series:
    return pd.Series(us, dtype="int64").astype("datetime64[us]").astype("datetime64[ns]")


def _timer(us: int) -> int:
    """Timers count milliseconds: the first one not before a moment."""
    return -(-us // 1000)


class Waiting(StatefulProcessor):
    """Keys that wait for a moment of event time. The state of a bucket is those that wait, and one timer for the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("waiting", "key array<string>, us array<long>")

    def _waiting(self) -> dict[str, int]:
        return dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}

    def _wait(self, waiting: dict[str, int], timer: int | None) -> None:
        """Keep what waits; `timer` is the one that is set."""
        first = _timer(min(waiting.values())) if waiting else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if waiting:
            self.state.update((list(waiting), list(waiting.values())))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        waiting = self._waiting()
        before, timer = dict(waiting), _timer(min(waiting.values())) if waiting else None
        out = self.changed(rows, waiting)
        if waiting != before:
            self._wait(waiting, timer)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        timer = expiredTimerInfo.getExpiryTimeInMs()
        until = max(timer + 1, timerValues.getCurrentWatermarkInMs())
        waiting = self._waiting()
        over = {k: us for k, us in waiting.items() if _timer(us) < until}
        self._wait({k: us for k, us in waiting.items() if k not in over}, timer)
        if over:
            yield self.over(list(over), list(over.values()))

    def close(self) -> None:
        pass


class Approval(Waiting):
    """A request waits for its decision until a timer of event time approves it."""

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def changed(self, rows, waiting: dict[str, int]) -> pd.DataFrame:
        d, parts = by_key(rows, "threat_id")
        at, decisions, found = micros(d["ts"]) if parts else [], d["decision"].tolist() if parts else [], []
        for name, a, b in parts:
            due = waiting.pop(name, None)
            for t, decision in zip(at[a:b], decisions[a:b], strict=True):
                if due is not None and t >= due:
                    found.append((name, "auto-approved", due))
                    due = None
                if decision is None:
                    due = due if due is not None else t + self.wait_us
                elif due is not None:
                    found.append((name, decision, t))
                    due = None
            if due is not None:
                waiting[name] = due
        return self._rows(*zip(*found, strict=True)) if found else pd.DataFrame()

    def over(self, keys: list[str], us: list[int]) -> pd.DataFrame:
        return self._rows(keys, ["auto-approved"] * len(keys), us)

    def _rows(self, keys, status, us) -> pd.DataFrame:
        return pd.DataFrame({"threat_id": list(keys), "status": list(status), "ts": _moments(list(us))})


def stream_approvals(events: DataFrame, minutes: int = 5, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """events (threat_id, id, ts, decision; no decision: the request) -> threat_id, status, ts of what was decided, or approved
    because the request had waited `minutes` of event time, as soon as the watermark says so. A decision in that instant or
    later finds it approved; one without a request, and a request while another of its threat waits, change nothing."""
    d = events.select(F.col("threat_id").cast("string").alias("threat_id"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "decision")
    d = d.where("threat_id is not null and ts is not null").withWatermark("ts", delay)
    return bucketed(d, "threat_id", buckets).transformWithStateInPandas(Approval(minutes * 60_000_000), "threat_id string, status string, ts timestamp", "Append", "EventTime")


class Sweep(Waiting):
    """When a session ends: its time to live after the last call, by a timer of event time."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def changed(self, rows, waiting: dict[str, int]) -> pd.DataFrame:
        d, parts = by_key(rows, "session_id")
        at, found = micros(d["ts"]) if parts else [], []
        for name, a, b in parts:
            last = waiting.get(name)
            for t in at[a:b]:
                if last is not None and t >= last:
                    found.append((name, last))
                last = t + self.ttl_us if last is None else max(last, t + self.ttl_us)
            waiting[name] = last
        return self.over(*zip(*found, strict=True)) if found else pd.DataFrame()

    def over(self, keys, us) -> pd.DataFrame:
        return pd.DataFrame({"session_id": list(keys), "ended_at": _moments(list(us))})


def stream_session_ends(calls: DataFrame, ttl_ms: int, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """calls (session_id, id, ts) -> session_id, ended_at: one row each time a session was without a call for ttl_ms of event
    time. A call after that begins a new one. The state of a session is one number; ended ones have none. Unlike
    stream_sessions this needs no clock, so the stream ends with its input; the last sessions stay open behind the watermark."""
    d = calls.select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    d = d.where("session_id is not null and ts is not null").withWatermark("ts", delay)
    return bucketed(d, "session_id", buckets).transformWithStateInPandas(Sweep(ttl_ms * 1000), "session_id string, ended_at timestamp", "Append", "EventTime")


def forward_audit(stream: DataFrame, sink_a: Callable[[DataFrame, int], None], sink_b: Callable[[DataFrame, int], None], checkpoint: str, level: str = "warn"):
    """Both projections of each batch to both sinks. If one raises, the batch comes again; sinks overwrite by batch id,
    so an event counts as delivered only when both have it. Returns the writer; call start()."""
    def deliver(batch: DataFrame, batch_id: int) -> None:
        due = A.min_severity(batch, level).persist()
        try:
            sink_a(io.provenance_records(due), batch_id)
            sink_b(io.attestation_records(due), batch_id)
        finally:
            due.unpersist()

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


class Forwarder:
    """Forwards audit events to two sinks with a cursor that stops before the first event that either did not take.

    A sink takes (records, n) and returns (seq, delivered), one row for each record; a record without a row counts as failed,
    and so does every record of a sink that raises. Events from the first failure on are kept below `path` and come again,
    before the next batch's or by retry(), also those after it that were taken: at least once, never lost. The cursor and what
    is kept are committed together in one row, after the deliveries; a batch that was committed is not delivered again.
    """

    STATE = "at long, batch long, cursor long, kept string"

    def __init__(self, path: str, sink_a: Callable[[DataFrame, int], DataFrame], sink_b: Callable[[DataFrame, int], DataFrame], level: str = "Warn"):
        self.path, self.sinks, self.level = path, ((sink_a, io.provenance_records), (sink_b, io.attestation_records)), level

    def _log(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(self.STATE).json(f"{self.path}/cursor")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.STATE)

    def state(self, spark: SparkSession) -> Row | None:
        """The last commit: cursor (null if nothing was taken so far) and the folder of kept events (null if there are none)."""
        return self._log(spark).orderBy(F.desc("at")).first()

    def deliver(self, batch: DataFrame, batch_id: int | None) -> None:
        spark = batch.sparkSession
        if batch_id is not None and not self._log(spark).where(F.col("batch") == batch_id).isEmpty():
            return
        old, at = self.state(spark), time.time_ns()
        if old is not None and old["kept"]:
            kept = spark.read.schema(batch.schema).parquet(f"{self.path}/{old['kept']}")
            batch = kept.unionByName(batch.join(kept.select("seq"), "seq", "left_anti"))
        elif batch.isEmpty():
            return
        batch.write.parquet(f"{self.path}/batches/{at}")  # what is delivered, recorded and kept is one and the same
        events = spark.read.schema(batch.schema).parquet(f"{self.path}/batches/{at}")
        due, taken = A.min_severity(events, self.level), spark.createDataFrame([], "seq long")
        for nth, (sink, records) in enumerate(self.sinks):
            results = f"{self.path}/results/{at}-{nth}"
            try:
                sink(records(due), at).select(F.col("seq").cast("long"), "delivered").write.parquet(results)
            except Exception:  # whatever a sink raises: its events stay
                logging.getLogger(__name__).exception("sink %d took nothing", nth)
                continue
            every = spark.read.schema("seq long, delivered boolean").parquet(results).groupBy("seq").agg(F.min(F.coalesce("delivered", F.lit(False))).alias("ok"))
            taken = taken.unionByName(every.where("ok").select("seq"))
        both = taken.groupBy("seq").agg((F.count(F.lit(1)) == len(self.sinks)).alias("delivered"))
        judged = events.select("seq", "severity").join(both, "seq", "left").withColumn("delivered", F.coalesce("delivered", F.lit(False)))
        step = A.advance_cursor(judged, self.level).first()
        failed, before = step["first_failed"], old["cursor"] if old is not None else None
        if failed is not None:
            events.where(F.col("seq") >= failed).write.parquet(f"{self.path}/kept/{at}")
        cursor = max((c for c in (before, step["cursor"]) if c is not None), default=None)
        spark.createDataFrame([(at, batch_id, cursor, f"kept/{at}" if failed is not None else None)], self.STATE).coalesce(1).write.mode("append").json(f"{self.path}/cursor")

    def retry(self, spark: SparkSession, schema: StructType) -> None:
        """Deliver what is kept, without a new batch."""
        self.deliver(spark.createDataFrame([], schema), None)

    def writer(self, stream: DataFrame, checkpoint: str):
        """stream (seq, severity and the other audit columns, in order of seq). Call start() on what it returns."""
        return stream.writeStream.foreachBatch(self.deliver).option("checkpointLocation", checkpoint)


def threat_intel_stream(stream: DataFrame, node_id: str, publish: Callable[[DataFrame, int], None], checkpoint: str):
    return A.threat_intel(stream, node_id).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
