"""Windowed observations of access-log rows, baselines, and deviations from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import scalars as S
from palisade.plans.ordered import carried, halo
from palisade.plans.scratch import save
from palisade.thresholds import DEFAULTS, Thresholds

CORE = ("connection_rate", "traffic_volume", "port_diversity")
HTTP = ("request_rate", "path_diversity", "error_rate_4xx")
DIMENSIONS = CORE + HTTP


def _measured(log: DataFrame, key: list[str], seconds: float) -> DataFrame:
    """One row for each key (a source and its window) of log rows. Rates divide by the whole window, also when it is partial.

    Sets are no aggregates here: collect_set makes an object for each group before the shuffle, where most groups have a row or
    two. Rows are counted by path, method and port instead (plain sums, so a busy source spreads over its paths), and what is
    left of a key is put together by windows over it, which spill.
    """
    status = S.status_class(F.col("status"))
    of = lambda cls: F.sum(F.when(status == cls, 1).otherwise(0))
    path, method = F.nullif(F.col("uri"), F.lit("")).alias("_path"), F.nullif(F.col("method"), F.lit("")).alias("_method")
    sums = {"n_requests": F.count(F.lit(1)), "_total": F.sum("size"), "_c4": of("4xx"), "_c5": of("5xx"), "_time": F.sum("duration"), "_timed": F.count("duration")}
    once = log.groupBy(*key, path, method, S.port_of(F.col("host")).alias("_port")).agg(*[c.alias(k) for k, c in sums.items()])
    by_path = W.partitionBy(*key).orderBy("_path")
    whole = by_path.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = once.withColumns({
        "_row": F.row_number().over(by_path), "_paths": F.dense_rank().over(by_path), **{k: F.sum(k).over(whole) for k in sums}, "_rows": F.count(F.lit(1)).over(whole),
        "_no_path": F.max(F.col("_path").isNull().cast("int")).over(whole), "_ports": F.collect_set("_port").over(whole), "_methods": F.collect_set("_method").over(whole)}).where("_row = _rows")
    n, total = F.col("n_requests"), F.col("_total")
    return d.select(
        *key, (n / F.lit(float(seconds))).alias("connection_rate"), F.floor(total / F.lit(float(seconds))).cast("bigint").alias("traffic_volume"), F.array_sort("_ports").alias("ports_accessed"), (n / F.lit(float(seconds))).alias("request_rate"),
        (F.col("_c4") / n).alias("error_rate_4xx"), (F.col("_c5") / n).alias("error_rate_5xx"), (F.col("_paths") - F.col("_no_path")).cast("int").alias("path_diversity"),
        F.floor(total / n).cast("bigint").alias("avg_payload_bytes"), F.least(F.size("_methods"), F.lit(255)).alias("method_diversity"), F.round(F.col("_time") / F.nullif(F.col("_timed"), F.lit(0)) * 1000, 6).alias("avg_duration_ms"), "n_requests")


def seconds_of(window: str) -> int:
    number, unit = window.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def aggregate_windows(log: DataFrame, window: str = "60 seconds") -> DataFrame:
    """One row for each source and tumbling window; ts is the window's start. A busy source spreads over its windows."""
    out = _measured(log.withColumn("_ts", F.window("ts", window)["start"]), ["source", "_ts"], seconds_of(window))
    return out.withColumn("ts", F.col("_ts")).drop("_ts")


def anchored_windows(log: DataFrame, seconds: float, by: str = "log_id") -> DataFrame:
    """Windows that open with the first event of a log: one at or after start + seconds closes it and opens the next.

    A row dated before the open window belongs to it. A log of any size is cut up: each distinct time points to the first
    one that would close a window opened there (a scan from the end); which of them do open one follows by pointer
    doubling from the first, in as many rounds as the number of windows has binary digits. Rows without a time are in no
    window.
    """
    keyed = log.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    times = save(keyed.where("t is not null").select(F.col(by).alias("k"), "t").distinct(), "times")
    # from the end: at t + seconds, the last time passed is the first one not before it
    at = times.select("k", (-F.col("t")).alias("o"), F.lit(0).alias("nth"), "t").unionByName(times.select("k", (-F.col("t") - int(seconds * 1_000_000)).alias("o"), F.lit(1).alias("nth"), "t"))
    hops = carried(at, ["k"], ["o", "nth"], F.when(F.col("nth") == 0, F.col("t")), "to").where("nth = 1").select("k", "t", "to")
    hops = save(hops.where("to is not null"), "hops")
    starts = times.groupBy("k").agg(F.min("t").alias("t"))
    while True:
        starts = save(starts, "starts")
        same = lambda a, b: a["k"].eqNullSafe(b["k"])
        more = starts.alias("s").join(hops.alias("h"), same(starts, hops) & (starts["t"] == hops["t"])).select(F.col("s.k"), F.col("h.to").alias("t"))
        more = save(more, "more")
        if more.isEmpty():
            break
        starts = starts.unionByName(more)
        next_, last = hops.toDF("k2", "t2", "to2"), hops
        hops = save(last.join(next_, last["k"].eqNullSafe(next_["k2"]) & (last["to"] == next_["t2"])).select("k", "t", F.col("to2").alias("to")), "hops")
    opened = times.join(starts.withColumn("start", F.col("t")).withColumnsRenamed({"k": "k2", "t": "t2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    opened = carried(opened.select("k", "t", "start"), ["k"], ["t"], F.col("start"), "opened").select("k", F.col("t").alias("_t"), F.col("opened").alias("start"))
    keyed = keyed.join(opened, F.col(by).eqNullSafe(F.col("k")) & (F.col("t") == F.col("_t")))
    out = _measured(keyed, [by, "source", "start"], seconds)
    return out.withColumn("ts", F.timestamp_micros("start").cast("timestamp_ntz")).drop("start")


def with_dimensions(obs: DataFrame) -> DataFrame:
    """Adds port_diversity (array length, repeats count). HTTP dimensions may be null."""
    return obs.withColumn("port_diversity", F.size("ports_accessed").cast("double"))


def _stats(window, dims=DIMENSIONS) -> dict[str, Column]:
    out: dict[str, Column] = {"_n": F.count(F.lit(1)).over(window)}
    for d in dims:
        out |= {f"{d}_mean": F.avg(d).over(window), f"{d}_std": F.stddev_pop(d).over(window)}
    return out


def rolling_score(obs: DataFrame, th: Thresholds = DEFAULTS, include_self: bool = True, key: list[str] | None = None, order: tuple[str, ...] = ("ts",), block: int | None = None, stored: bool = False) -> DataFrame:
    """Mean and spread of the last `window` observations, and the z-score of each dimension against them.

    include_self scores a row against a window that holds it (z is then at most sqrt(n - 1)); without, the row is
    judged before it is learned. Nothing is scored until min_observations rows are known. `order` must be unique
    within a key. key=[] is one global profile. Windowed observations have at most one row a window for each source,
    so a source's rows are bounded by the time that the table spans; where a key may hold more, give `block`: keys of
    any size are then cut into parallel blocks. stored=True says that obs is a table, cheap to read twice: keys are counted
    first, and those of at most `window` rows get frames that only grow, which cost a step a row instead of a frame a row.
    """
    key = ["source"] if key is None else key
    d = with_dimensions(obs)
    frame = (-(th.window - 1), 0) if include_self else (-th.window, -1)
    if block or not key:
        d = halo(d, key, list(order), th.window, lambda w: _stats(w.rowsBetween(*frame)), block or 100_000)
    else:
        w = W.partitionBy(*key).orderBy(*order)
        slid = lambda x: x.withColumns(_stats(w.rowsBetween(*frame)))
        d = _grown(d, key, th.window, lambda x: x.withColumns(_stats(w.rowsBetween(W.unboundedPreceding, frame[1]))), slid) if stored else slid(d)
    return with_z(d, th)


def _grown(d: DataFrame, key: list[str], window: int, grown: Callable[[DataFrame], DataFrame], slid: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """grown(d) for keys of at most `window` rows, slid(d) for the others. Both give the same: no frame has left a row behind."""
    large = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > window)
    large = save(large.select(*[F.col(k).alias(f"_large{i}") for i, k in enumerate(key)]), "large")
    if large.isEmpty():
        return grown(d)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large{i}")) for i, k in enumerate(key)])
    return grown(d.join(large, on, "left_anti")).unionByName(slid(d.join(large, on, "left_semi")))


def with_z(d: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Rows with count (_n), mean and spread -> plus `established` and the z-score of each dimension."""
    known = F.col("_n") >= th.min_observations
    z = {f"{k}_z": F.when(known & F.col(k).isNotNull(), S.z_score(F.col(k).cast("double"), F.col(f"{k}_mean"), F.col(f"{k}_std"))) for k in DIMENSIONS}
    return d.withColumn("established", known).withColumns(z)


def anomalies(scored: DataFrame, th: Thresholds = DEFAULTS, keep: tuple[str, ...] = ("source", "ts")) -> DataFrame:
    """One row for each dimension that deviates. Infinite deviations have is_infinite and deviation -1."""
    parts = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("double").alias("observed"), F.col(f"{k}_mean").alias("mean"), F.col(f"{k}_std").alias("std_dev"), F.col(f"{k}_z").alias("z")) for k in DIMENSIONS])
    long = scored.select(*keep, F.explode(parts).alias("d")).select(*keep, "d.*").where(F.col("z").isNotNull() & S.exceeds(F.col("z"), th.sigma))
    inf = F.col("z") == float("inf")
    return long.select(*keep, "dimension", "observed", "mean", "std_dev", F.when(inf, -1.0).otherwise(F.col("z")).alias("deviation"), inf.alias("is_infinite"), S.confidence(F.col("z"), th).alias("confidence"), S.severity_of(F.col("z"), th).alias("severity"))


def http_anomalies(found: DataFrame) -> DataFrame:
    return found.where(F.col("dimension").isin(*HTTP))


def melt_dimensions(obs: DataFrame, keep: tuple[str, ...] = ("source", "ts")) -> DataFrame:
    """One row for each dimension with a value: the core ones always, HTTP ones where there are any."""
    d = with_dimensions(obs).select(*keep, *[F.col(k).cast("double").alias(k) for k in DIMENSIONS])
    return d.unpivot(list(keep), list(DIMENSIONS), "dimension", "value").where("value is not null")


def moments(df: DataFrame, value: str, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), F.count(value).alias("n"))


def last_n(df: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """The newest n rows of each key."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def baseline_stats(obs: DataFrame, th: Thresholds = DEFAULTS, key: str = "source", order: tuple[str, ...] = ("ts",), percentiles: tuple[float, ...] = ()) -> DataFrame:
    """(key, dimension, mean, std_dev, n, observation_count) over the last `window` rows of a key; mean and std_dev are
    null until min_observations rows are known. HTTP dimensions use rows that have them."""
    recent = last_n(obs, th.window, [key], list(order)).withColumn("observation_count", F.count(F.lit(1)).over(W.partitionBy(key)))
    long = melt_dimensions(recent, (key, "observation_count"))
    extra = [F.percentile("value", F.lit(p)).alias(f"p{round(p * 100)}") for p in percentiles]
    g = long.groupBy(key, "observation_count", "dimension").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_dev"), F.count(F.lit(1)).alias("n"), *extra)
    known = F.col("observation_count") >= th.min_observations
    return g.withColumns({"mean": F.when(known, F.col("mean")), "std_dev": F.when(known, F.col("std_dev"))})


def score_against(obs: DataFrame, stats: DataFrame, th: Thresholds = DEFAULTS, keep: tuple[str, ...] = ("source", "ts")) -> DataFrame:
    """Observations against a baseline table, learning nothing. stats has a row for each source and dimension."""
    j = melt_dimensions(obs, keep).join(stats.select("source", "dimension", "mean", "std_dev"), ["source", "dimension"])
    z = S.z_score(F.col("value"), F.col("mean"), F.col("std_dev"))
    j = j.withColumn("z", F.when(F.col("mean").isNotNull(), z)).where(F.col("z").isNotNull() & S.exceeds(F.col("z"), th.sigma))
    inf = F.col("z") == float("inf")
    return j.select(*keep, "dimension", F.col("value").alias("observed"), "mean", "std_dev", F.when(inf, -1.0).otherwise(F.col("z")).alias("deviation"), S.confidence(F.col("z"), th).alias("confidence"))


def latest(df: DataFrame, key: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest row of each key."""
    g = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return g.select("r.*")


def over_last(df: DataFrame, key: str, order: tuple[str, ...], frame: tuple[int, int], columns: Callable[[W], dict[str, Column]], block: int | None) -> DataFrame:
    """df plus columns over the last rows of each key: one task a key, or with `block` in parallel within a key."""
    over = lambda w: columns(w.rowsBetween(*frame))
    return halo(df, [key], list(order), -frame[0], over, block) if block else df.withColumns(over(W.partitionBy(key).orderBy(*order)))


def counter_rate(df: DataFrame, key: str = "host", counter: str = "forks_total", order: tuple[str, ...] = ("ts",), block: int | None = None) -> DataFrame:
    """Increase per second since the previous sample; 0 for the first, after a reset, and if no time has passed."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    d = over_last(df, key, order, (-1, -1), lambda w: {"_d": F.col(counter) - F.first(counter).over(w), "_t": (at - F.first(at).over(w)) / 1_000_000}, block)
    return d.withColumn("rate", F.when((F.col("_d") >= 0) & (F.col("_t") > 0), F.col("_d") / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(0.0)).drop("_d", "_t")


def failure_rate(probes: DataFrame, th: Thresholds = DEFAULTS, key: str = "channel", order: tuple[str, ...] = ("ts",), block: int | None = None) -> DataFrame:
    """Failures, probes and failure rate over the last failure_window probes of a channel. Counts up to a row less those up
    to the row that the window has left: two frames that only grow."""
    bad, n = F.when(F.col("success"), 0).otherwise(1), th.failure_window
    upto = lambda w, last: w.rowsBetween(W.unboundedPreceding, last)
    columns = lambda w: {"failures": (F.sum(bad).over(upto(w, 0)) - F.coalesce(F.sum(bad).over(upto(w, -n)), F.lit(0))).cast("int"), "probes": F.least(F.count(F.lit(1)).over(upto(w, 0)), F.lit(n)).cast("int")}
    d = over_last(probes, key, order, (-(n - 1), 0), columns, block)
    return d.withColumn("failure_rate", F.col("failures") / F.col("probes"))


def metric_baseline(df: DataFrame, domain: str, value: str, order: tuple[str, ...], th: Thresholds = DEFAULTS, include_self: bool = False, block: int | None = None) -> DataFrame:
    """Any metric with one value, profiled by domain."""
    frame = (-(th.window - 1), 0) if include_self else (-th.window, -1)
    d = over_last(df, domain, order, frame, lambda w: {"n": F.count(F.lit(1)).over(w), "mean": F.avg(value).over(w), "std_dev": F.stddev_pop(value).over(w)}, block)
    z = F.when(F.col("n") >= th.min_observations, S.z_score(F.col(value).cast("double"), F.col("mean"), F.col("std_dev")))
    return d.withColumn("z", z).withColumn("anomalous", F.coalesce(S.exceeds(F.col("z"), th.sigma), F.lit(False)))


def seasonal_baseline(obs: DataFrame, value: str, *key: str) -> DataFrame:
    """Mean and spread by hour of day and day of week (1 = Sunday)."""
    d = obs.withColumns({"hour": F.hour("ts"), "weekday": F.dayofweek("ts")})
    return d.groupBy(*key, "hour", "weekday").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), F.count(F.lit(1)).alias("n"))


def reset_baseline(obs: DataFrame, resets: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Observations after the last reset (source, reset_at) of their source, with optional seed rows. Make seeds for the
    sources of `resets`: one without rows after its reset starts from its seed alone."""
    last = resets.groupBy("source").agg(F.max("reset_at").alias("reset_at"))
    kept = obs.join(last, "source", "left").where("reset_at is null or ts > reset_at").drop("reset_at")
    return kept if seed is None else kept.unionByName(seed, allowMissingColumns=True)


def seed_observations(spark, sources: DataFrame) -> DataFrame:
    """Twelve ordinary observations for each source, dated before everything else."""
    # fixed values: (connections a second, bytes, ports)
    rows = [(3.2, 2048, [9750]), (2.8, 1536, [9750, 0]), (4.1, 3072, [9750]), (3.5, 2560, [9750, 0]), (5.0, 4096, [9750]), (2.1, 1024, [0]), (4.8, 3584, [9750, 0]), (3.9, 2816, [9750]), (2.5, 1280, [0]), (4.3, 3328, [9750]), (3.0, 2048, [9750, 0]), (5.2, 4352, [9750])]
    seed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, connection_rate double, traffic_volume long, ports_accessed array<int>")
    nothing = {c: F.lit(None).cast("double") for c in HTTP}
    return sources.select("source").distinct().join(F.broadcast(seed)).withColumn("ts", F.timestamp_seconds(F.col("i")).cast("timestamp_ntz")).drop("i").withColumns(nothing)
