"""A store by day: what expires, what stays, what a read opens."""

import datetime as dt

from pyspark.sql import functions as F

from palisade.sources import retention


def now():
    return F.lit("2024-03-10 06:00:00").cast("timestamp_ntz")


def store(spark, tmp_path):
    at = dt.datetime(2024, 3, 10, 6)
    rows = [(h, at - dt.timedelta(hours=h)) for h in range(24 * 12)] + [(-1, None)]
    path = f"file://{tmp_path}/store"
    retention.append(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), path)
    return path


def test_days_are_dropped_whole_and_rows_exactly(spark, tmp_path):
    path = store(spark, tmp_path)
    before = sorted(r["id"] for r in retention.recent(spark, path, now(), 24).collect())
    gone = retention.drop_expired(spark, path, now(), 24)
    assert gone == [f"2024-02-{d}" for d in (27, 28, 29)] + [f"2024-03-{d:02}" for d in range(1, 9)]
    assert before == sorted(r["id"] for r in retention.recent(spark, path, now(), 24).collect()) == list(range(24))
    assert spark.read.parquet(path).count() == 24 + 7 + 1  # the limit's own day, and the row without a time
    assert retention.drop_expired(spark, path, now(), 24) == []


def test_a_week_at_most(spark, tmp_path):
    path = store(spark, tmp_path)
    assert retention.recent(spark, path, now(), 10_000).count() == 168
    assert max(retention.drop_expired(spark, path, now(), 10_000)) == "2024-03-02"


def test_reads_open_only_recent_days(spark, tmp_path):
    d = retention.recent(spark, store(spark, tmp_path), now(), 24)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    opened = {r["f"].split("day=")[1][:10] for r in d.select(F.input_file_name().alias("f")).collect()}
    assert opened == {"2024-03-09", "2024-03-10"}
