"""Tables in the shared scratch folder, to cut lineage and to feed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only if that is unset and the master is this machine alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or "file:///tmp/spark-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write and read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
