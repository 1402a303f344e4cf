"""Forwarding with a cursor that stops at failures, and quarantine changes merged into snapshots."""

import pytest
from pyspark.sql import functions as F

from palisade.sources import io
from palisade.streaming import jobs

AUDIT = "seq long, ts timestamp, severity string, source string, kind string, subject string, detail string, correlation_id string"
CHANGES = "event_id long, source string, ts timestamp, op string, threat_id string"


def audit(spark, *events):
    at = F.lit("2024-01-01").cast("timestamp")
    d = spark.createDataFrame([(q, s) for q, s in events], "seq long, severity string")
    rest = [F.lit("x").alias(c) for c in ("source", "kind", "subject", "detail", "correlation_id")]
    return d.select("seq", at.alias("ts"), "severity", *rest)


class Sinks:
    """Two sinks that note what they were given; `bad` are events that the second does not take."""

    def __init__(self):
        self.bad, self.away, self.seen = set(), False, ([], [])

    def first(self, records, n):
        self.seen[0].append(sorted(r["seq"] for r in records.collect()))
        return records.select("seq", F.lit(True).alias("delivered"))

    def second(self, records, n):
        if self.away:
            raise OSError("sink is away")
        self.seen[1].append(sorted(r["seq"] for r in records.select("anchor.seq").collect()))
        ok = ~F.col("anchor.seq").isin(*self.bad) if self.bad else F.lit(True)
        return records.select("anchor.seq", ok.alias("delivered"))


@pytest.fixture
def forward(spark, tmp_path):
    sinks = Sinks()
    return sinks, jobs.Forwarder(f"file://{tmp_path}/f", sinks.first, sinks.second)


def test_cursor_stops_before_the_first_failure_and_goes_on_there(spark, forward):
    sinks, f = forward
    sinks.bad = {4}
    f.deliver(audit(spark, (1, "Warn"), (2, "Info"), (3, "Info"), (4, "Error"), (5, "Info"), (6, "Warn")), 0)
    assert f.state(spark)["cursor"] == 3
    f.deliver(audit(spark, (7, "Warn"), (8, "Info")), 1)
    assert f.state(spark)["cursor"] == 3 and sinks.seen[0] == [[1, 4, 6], [4, 6, 7]]
    sinks.bad = set()
    f.retry(spark, audit(spark, (1, "Warn")).schema)
    assert f.state(spark)["cursor"] == 8 and f.state(spark)["kept"] is None
    assert sinks.seen[1] == [[1, 4, 6], [4, 6, 7], [4, 6, 7]]


def test_a_committed_batch_is_not_delivered_again(spark, forward):
    sinks, f = forward
    one = audit(spark, (1, "Warn"), (2, "Warn"))
    f.deliver(one, 0)
    f.deliver(one, 0)
    assert sinks.seen == ([[1, 2]], [[1, 2]]) and f.state(spark)["cursor"] == 2


def test_a_sink_that_raises_took_nothing(spark, forward):
    sinks, f = forward
    sinks.away = True
    f.deliver(audit(spark, (1, "Info"), (2, "Warn"), (3, "Warn")), 0)
    assert f.state(spark)["cursor"] == 1
    sinks.away = False
    f.retry(spark, audit(spark, (1, "Warn")).schema)
    assert f.state(spark)["cursor"] == 3 and sinks.seen == ([[2, 3], [2, 3]], [[2, 3]])


def test_first_event_fails_and_empty_batches(spark, forward):
    sinks, f = forward
    empty = spark.createDataFrame([], AUDIT)
    f.deliver(empty, 0)
    assert f.state(spark) is None and sinks.seen == ([], [])
    sinks.bad = {1}
    f.deliver(audit(spark, (1, "Warn")), 1)
    assert f.state(spark)["cursor"] is None and f.state(spark)["kept"]
    sinks.bad = set()
    f.deliver(empty, 2)
    assert f.state(spark)["cursor"] == 1


def merge(spark, tmp_path, rows):
    src, checkpoint = f"file://{tmp_path}/changes", f"file://{tmp_path}/checkpoint"
    d = spark.createDataFrame(rows, "event_id long, source string, ts string, op string, threat_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.mode("append").parquet(src)
    jobs.merge_quarantine(spark.readStream.schema(d.schema).parquet(src), f"file://{tmp_path}/q", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {(r["source"], r["threat_id"]) for r in io.load_quarantine(spark, f"file://{tmp_path}/q").collect()}


def test_changes_are_merged_run_by_run(spark, tmp_path):
    day = "2024-01-01"
    assert merge(spark, tmp_path, [(1, "a", day, "enter", "t1"), (2, "b", day, "enter", "t2"), (3, "b", day, "release", None), (4, None, day, "enter", "t3"), (5, "c", day, None, None)]) == {("a", "t1")}
    assert merge(spark, tmp_path, [(6, "b", day, "enter", "t4"), (7, "a", day, "release", None), (8, "c", day, "release", None)]) == {("b", "t4")}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    import shutil

    rows = [(1, "a", "2024-01-01", "enter", "t1"), (2, "b", "2024-01-01", "enter", "t2")]
    first = merge(spark, tmp_path, rows)
    shutil.rmtree(f"{tmp_path}/checkpoint")  # the commit of the batch was lost
    assert merge(spark, tmp_path, [(3, "b", "2024-01-02", "enter", "t2")]) == first == {("a", "t1"), ("b", "t2")}


def test_an_unreadable_snapshot_stops_the_merge(spark, tmp_path):
    import shutil

    merge(spark, tmp_path, [(1, "a", "2024-01-01", "enter", "t1")])
    shutil.rmtree(f"{tmp_path}/q/versions")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        merge(spark, tmp_path, [(2, "b", "2024-01-01", "enter", "t2")])
