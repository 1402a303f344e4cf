"""Global order without a single task: ranks, and windows over the last N rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import save


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 by `order`, which must be unique for a repeatable result.

    One shuffle: rows are range-partitioned, sorted and written with their partition's number and their own in it; the rank
    adds the rows of earlier partitions, a list of one number a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_rank_p"), inner.alias("_rank_n"))
    d = save(d, "ranged")
    sizes = {r["_rank_p"]: r["n"] for r in d.groupBy("_rank_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *accumulate(sizes.get(p, 0) for p in range(n))]
    return d.withColumn(name, (F.get(F.lit(before), F.col("_rank_p")) + F.col("_rank_n") + 1).cast("long")).drop("_rank_p", "_rank_n")


def halo(df: DataFrame, key: list[str], order: list[str], size: int, columns: Callable[[W], dict[str, Column]], block: int = 100_000) -> DataFrame:
    """`columns(window)` over frames that look back at most `size` rows of the same key, in parallel within a key.

    A key of at most `block` rows is one group. The others, which are counted first, are cut up: their global order
    (key, order) is divided into blocks; each block also gets the `size` rows before it, which are dropped again. One key,
    or none at all, may hold every row.
    """
    if block < size:
        raise ValueError("block must not be smaller than size")
    if not key:
        return _in_blocks(df, key, order, size, columns, block)
    large = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = save(large.select(*[F.col(k).alias(f"_large{i}") for i, k in enumerate(key)]), "large")
    whole = lambda d: d.withColumns(columns(W.partitionBy(*key).orderBy(*order)))
    if large.isEmpty():
        return whole(df)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_large{i}")) for i, k in enumerate(key)])
    rows = lambda how: df.join(F.broadcast(large), on, how)  # noqa: E731  (one row for each `block` rows at most)
    return whole(rows("left_anti")).unionByName(_in_blocks(rows("left_semi"), key, order, size, columns, block))


def _in_blocks(df: DataFrame, key: list[str], order: list[str], size: int, columns: Callable[[W], dict[str, Column]], block: int) -> DataFrame:
    d = global_rank(df, *key, *order, name="_r").withColumn("_own", F.floor((F.col("_r") - 1) / block))
    ends = F.pmod(F.col("_r") - 1, F.lit(block)) >= block - size
    both = d.select("*", F.explode(F.when(ends, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))).alias("_b"))
    window = W.partitionBy(*key, "_b").orderBy("_r")
    return both.withColumns(columns(window)).where(F.col("_b") == F.col("_own")).drop("_r", "_b", "_own")


def carried(df: DataFrame, key: list[str], order: list[str], value: Column, name: str, how: str = "last", inclusive: bool = True) -> DataFrame:
    """df plus `name`: the last value that is not null (or the greatest so far) among the rows of the key up to each row,
    itself included or not. Rows with equal `order` should have equal values, or be told apart by it.

    A segmented scan: rows are range-partitioned by key and order, so one key may fill many partitions; each is scanned by
    itself, and what its earlier partitions carry into it is a second scan over one row for each key and partition. Only
    keys that cross a border have such a row with a value, at most two for each partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = save(df.withColumn("_scan_v", value).repartitionByRange(n, *key, *order).withColumn("_scan_p", F.spark_partition_id()), "ranged")
    scan = (lambda c, w: F.last(c, ignorenulls=True).over(w)) if how == "last" else (lambda c, w: F.max(c).over(w))
    end = F.max_by("_scan_v", F.when(F.col("_scan_v").isNotNull(), F.struct(*order))) if how == "last" else F.max("_scan_v")
    ends = d.groupBy(*key, "_scan_p").agg(end.alias("_scan_end"))
    earlier = scan("_scan_end", W.partitionBy(*key).orderBy("_scan_p").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(key)], F.col("_scan_p").alias("_scan_q"), earlier.alias("_scan_earlier")).where(F.col("_scan_earlier").isNotNull())
    on = F.col("_scan_p") == F.col("_scan_q")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    inner = scan("_scan_v", W.partitionBy(*key, "_scan_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    joined = d.withColumn("_scan_inner", inner).join(F.broadcast(ends), on, "left")
    both = F.coalesce("_scan_inner", "_scan_earlier") if how == "last" else F.greatest("_scan_inner", "_scan_earlier")
    return joined.withColumn(name, both).select(*df.columns, name)
