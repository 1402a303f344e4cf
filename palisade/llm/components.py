"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component_id): for every id that has an edge, the smallest id it can reach.

    Each step points edges at a smaller neighbour, so the table becomes a set of stars in a number of rounds that
    grows with the logarithm of the longest path. Minima are combined before the shuffle, so a hub costs one row a
    task. Every round is written to the shared scratch folder, and so are the minima of a large table: a join with a
    table is one whose hubs can be split. Loops and null ids are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = C.save(e, "edges")
    mark = _mark(e)

    def minima(rows: DataFrame) -> DataFrame:
        low = rows.groupBy("u").agg(F.min("v").alias("m"))
        return C.small(C.save(low, "minima")) if mark[0] > C.SMALL_ROWS else low

    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = minima(large)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = C.save(small.where("u != v").distinct(), "edges")
        was, mark = mark, _mark(e)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).groupBy("id").agg(F.min("component_id").alias("component_id"))


def _mark(e: DataFrame) -> tuple:
    """Number of edges and an order-free checksum: equal before and after a round only when nothing changed."""
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(r)
