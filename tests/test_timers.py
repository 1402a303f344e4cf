"""Streams that act when event time has passed."""

import pytest
from pyspark.sql import functions as F

from palisade.plans.scratch import folder
from palisade.streaming import jobs
from palisade.streaming.queries import run


def day(hour, minute=0, d=1):
    return f"2024-01-{d:02} {hour:02}:{minute:02}:00"


class Feed:
    """A stream of files that is run to its end after each put."""

    def __init__(self, spark, ddl, job):
        self.spark, self.ddl, self.job = spark, ddl, job
        self.path, self.out, self.checkpoint = (folder(spark, n) for n in ("in", "out", "checkpoint"))

    def put(self, *rows):
        d = self.spark.createDataFrame(rows, self.ddl).withColumn("ts", F.col("ts").cast("timestamp"))
        d.coalesce(1).write.mode("append").parquet(self.path)
        stream = self.job(self.spark.readStream.schema(d.schema).parquet(self.path))
        run(stream, self.out, self.checkpoint)
        got = self.spark.read.schema(stream.schema).parquet(self.out)
        return sorted(tuple(str(v) for v in r) for r in got.collect())


@pytest.fixture
def approvals(spark):
    return Feed(spark, "threat_id string, id long, ts string, decision string", lambda d: jobs.stream_approvals(d, 5, "1 minute"))


def test_approvals_over_batches(approvals):
    first = approvals.put(("a", 1, day(1), None), ("b", 2, day(1), None), ("b", 3, day(1, 4), "denied"), ("c", 4, day(1), None), ("c", 5, day(1, 5), "denied"), ("d", 6, day(1), "denied"), (None, 7, day(1), None))
    assert first == [("b", "denied", day(1, 4)), ("c", "auto-approved", day(1, 5))]
    second = approvals.put(("e", 8, day(2), None), ("b", 9, day(2), None), ("b", 10, day(2, 1), None))
    assert ("a", "auto-approved", day(1, 5)) in second and len(second) == 3  # e and b wait
    third = approvals.put(("e", 11, day(2, 3), "approved"), ("z", 12, day(3), "denied"))
    assert third == sorted([*second, ("e", "approved", day(2, 3)), ("b", "auto-approved", day(2, 5))])


def test_session_ends_over_batches(spark):
    calls = Feed(spark, "session_id string, id long, ts string", lambda d: jobs.stream_session_ends(d, 3_600_000, "0 seconds"))
    assert calls.put(("a", 1, day(1)), ("a", 2, day(1, 59)), ("a", 3, day(3)), ("b", 4, day(1)), (None, 5, day(1))) == [("a", day(2, 59)), ("b", day(2))]
    assert calls.put(("a", 6, day(3, 30)), ("c", 7, day(3, 40))) == [("a", day(2, 59)), ("b", day(2))]
    assert calls.put(("x", 8, day(9))) == sorted([("a", day(2, 59)), ("b", day(2)), ("a", day(4, 30)), ("c", day(4, 40))])
