"""Providers and capabilities, topology, integrity, health and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def registry_state(announcements: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last announcement of each provider, unless it takes the provider back."""
    w = W.partitionBy("primal_id").orderBy(*[F.desc(c) for c in order])
    return announcements.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op <> 'remove'").drop("_n", "op")


def registry_stats(registry: DataFrame) -> DataFrame:
    """Providers, distinct capabilities, and capabilities a provider (0.0 for none)."""
    caps = registry.select(F.explode("capabilities").alias("c")).agg(F.count_distinct("c").alias("capabilities"))
    return registry.agg(F.count(F.lit(1)).alias("providers"), F.coalesce(F.avg(F.size("capabilities")), F.lit(0.0)).alias("avg_per_provider")).join(F.broadcast(caps))


def discover(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(capability, primal_id, endpoint) for the capabilities asked for; unknown ones have no row."""
    return registry.select("primal_id", "endpoint", F.explode("capabilities").alias("capability")).join(wanted.select("capability").distinct(), "capability").select("capability", "primal_id", "endpoint")


def map_connections(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """Edges between known nodes, from a table of flows. Flows are summed before the joins."""
    f = flows.groupBy("from", "to", "protocol").agg(F.count(F.lit(1)).alias("n_flows"))
    known = nodes.select("id").distinct()
    return f.join(known.withColumnRenamed("id", "from"), "from", "left_semi").join(known.withColumnRenamed("id", "to"), "to", "left_semi").select("from", "to", "protocol", "n_flows")


def all_nodes(own: DataFrame, discovered: DataFrame) -> DataFrame:
    return own.unionByName(discovered, allowMissingColumns=True)


def scan(own: DataFrame, discovered: DataFrame, flows: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a network scan; both empty if scanning is off."""
    nodes = all_nodes(own, discovered)
    edges = map_connections(nodes, flows)
    return (nodes, edges) if enabled else (nodes.limit(0), edges.limit(0))


def topology_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (from, to, protocol) that were added or removed between two scans."""
    key = ["from", "to", "protocol"]
    j = old.select(*key).distinct().withColumn("_o", F.lit(True)).join(new.select(*key).distinct().withColumn("_n", F.lit(True)), key, "full")
    return j.where("_o is null or _n is null").select(*key, F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("change"))


def verify_integrity(content: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every address of the manifest with whether its content differs; missing content or hash is an empty string."""
    return manifest.select("address", "expected_hash").join(content.select("address", "hash"), "address", "left").select("address", (F.coalesce("hash", F.lit("")) != F.col("expected_hash")).alias("violated"))


def integrity_sweep(content: DataFrame, max_listed: int = 1000) -> DataFrame:
    """One row: checked, violations, and at most max_listed violating addresses (the table of all is verify_integrity)."""
    bad = (F.coalesce("hash", F.lit("")) != F.col("expected_hash")) | (F.coalesce("hash", F.lit("")) == "")
    n = content.agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("violations"))
    some = content.where(bad).orderBy("address").limit(max_listed).agg(F.array_sort(F.collect_list("address")).alias("addresses"))
    return n.join(F.broadcast(some))


def health_rollup(health: DataFrame) -> DataFrame:
    """health (service, running, dependency, healthy) -> (service, status)."""
    g = health.groupBy("service").agg(F.bool_and("running").alias("up"), F.bool_and("healthy").alias("all"), F.array_sort(F.collect_set(F.when(~F.col("healthy"), F.col("dependency")))).alias("failing"))
    return g.select("service", F.when(~F.col("up"), "Unhealthy").when(F.col("all"), "Healthy").otherwise("Degraded").alias("status"), "failing")


def expire_sessions(sessions: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    return sessions.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)
