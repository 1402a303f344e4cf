"""Extension points. Every method takes and returns DataFrames, so the optimizer sees the whole plan."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import detect, observations, registry
from palisade.thresholds import DEFAULTS, Thresholds


class LineageSource(Protocol):
    def roster(self, peers: DataFrame) -> DataFrame: ...


class Profiler(Protocol):
    def stats(self, obs: DataFrame) -> DataFrame: ...
    def score(self, obs: DataFrame) -> DataFrame: ...


class PathValidator(Protocol):
    def validate(self, paths: DataFrame) -> DataFrame: ...


class NodeSource(Protocol):
    def nodes(self) -> DataFrame: ...


class EdgeSource(Protocol):
    def edges(self, nodes: DataFrame, flows: DataFrame) -> DataFrame: ...


class ThreatSink(Protocol):
    def publish(self, batch: DataFrame, batch_id: int) -> None: ...


class SigmaProfiler:
    """The default profiler: mean and population standard deviation of the last observations."""

    def __init__(self, th: Thresholds = DEFAULTS):
        self.th = th

    def stats(self, obs: DataFrame) -> DataFrame:
        return observations.baseline_stats(obs, self.th)

    def score(self, obs: DataFrame) -> DataFrame:
        return observations.anomalies(observations.rolling_score(obs, self.th), self.th)


class MedianProfiler(SigmaProfiler):
    """Median and 1.4826 times the median absolute deviation instead: outliers do not widen the baseline."""

    def stats(self, obs: DataFrame) -> DataFrame:
        long = observations.melt_dimensions(observations.last_n(obs, self.th.window, ["source"], ["ts"]))
        mid = long.groupBy("source", "dimension").agg(F.median("value").alias("mean"), F.count(F.lit(1)).alias("n"))
        dev = long.join(mid, ["source", "dimension"]).groupBy("source", "dimension", "mean", "n").agg((F.lit(1.4826) * F.median(F.abs(F.col("value") - F.col("mean")))).alias("std_dev"))
        return dev.where(F.col("n") >= self.th.min_observations)

    def score(self, obs: DataFrame) -> DataFrame:
        return observations.score_against(obs, self.stats(obs), self.th)


class FixedPathValidator:
    def __init__(self, th: Thresholds = DEFAULTS):
        self.th = th

    def validate(self, paths: DataFrame) -> DataFrame:
        return detect.detect_topology(paths, self.th)


class TableRoster:
    def __init__(self, table: DataFrame):
        self.table = table

    def roster(self, peers: DataFrame) -> DataFrame:
        return self.table.join(peers.select("peer_id").distinct(), "peer_id", "left_semi")


class TableTopology:
    """Nodes from a table of peers and one of services, edges from flows between known nodes."""

    def __init__(self, peers: DataFrame, services: DataFrame):
        self.peers, self.services = peers, services

    def nodes(self) -> DataFrame:
        return registry.all_nodes(self.peers, self.services)

    def edges(self, nodes: DataFrame, flows: DataFrame) -> DataFrame:
        return registry.map_connections(nodes, flows)


class FileSink:
    """Writes each batch once below a folder: a repeated batch overwrites its own folder."""

    def __init__(self, path: str):
        self.path = path

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
