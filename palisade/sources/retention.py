"""A store of timed rows in one folder a day: old days are dropped whole, and reads open only the days that they need.

`now` is a constant Column of the type of `ts`. Days are those of the session's time zone, so all calls on a store should
have the same. Rows without a time lie in a folder of their own: they never count as recent and never expire.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = re.compile(r"day=\d{4}-\d\d-\d\d")
#: Tasks, and so files, that one day of an append is written by.
WRITERS = 8


def _since(now: Column, hours: int, cap_hours: int) -> Column:
    return now - F.make_dt_interval(hours=F.lit(min(hours, cap_hours)))


def append(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Add rows to the store; those of a day go through WRITERS tasks, so that its files are few and no task has it alone."""
    df.withColumn("day", F.to_date(ts)).repartition("day", F.pmod(F.xxhash64(ts), F.lit(WRITERS))).write.partitionBy("day").mode("append").parquet(path)


def recent(spark: SparkSession, path: str, now: Column, hours: int = 24, cap_hours: int = 168, ts: str = "ts") -> DataFrame:
    """Rows younger than the time to live, which is a week at most; older days are not read."""
    since = _since(now, hours, cap_hours)
    return spark.read.parquet(path).where((F.col("day") >= F.to_date(since)) & (F.col(ts) > since)).drop("day")


def drop_expired(spark: SparkSession, path: str, now: Column, hours: int = 24, cap_hours: int = 168) -> list[str]:
    """Delete the days that hold no row younger than the time to live; returns them. The day of the limit itself stays
    until it is over: recent() leaves its older rows out."""
    first = spark.range(1).select(F.to_date(_since(now, hours, cap_hours)).cast("string")).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [f.getPath() for f in system.listStatus(root) if DAY.fullmatch(f.getPath().getName())]
    old = [d for d in days if d.getName().removeprefix("day=") < first]
    for d in old:
        system.delete(d, True)
    return sorted(d.getName().removeprefix("day=") for d in old)
