"""Following growing and rotated files by byte position: every whole line once."""

import os

import pytest

from palisade.sources import tail
from palisade.sources.tail import Tail


@pytest.fixture
def follow(spark, tmp_path):
    """A function that runs the stream over what is there and gives all lines so far, with their files."""
    spark.dataSource.register(Tail)
    logs = tmp_path / "logs"
    logs.mkdir()

    def run(range_bytes=7):
        s = spark.readStream.format("log_tail").option("path", str(logs)).option("range_bytes", range_bytes).load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["value"] for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect())

    return logs, run


def test_growth_restart_and_unfinished_lines(follow):
    logs, run = follow
    a = logs / "a.log"
    a.write_bytes(b"first\nsecond\r\n\nthi")
    (logs / "_hidden").write_bytes(b"no\n")
    (logs / "b.log").write_bytes(b"no end yet")
    assert run() == ["", "first", "second"]
    with a.open("ab") as f:
        f.write("rd é\n".encode() + b"x" * 100 + b"\nlast")
    assert run(3) == ["", "first", "second", "third é", "x" * 100]
    (logs / "b.log").write_bytes(b"no end yet, now\n\xff\n")
    assert run(1000) == ["", "first", "no end yet, now", "second", "third é", "x" * 100, "�"]
    assert run() == run()


def test_rotation_and_truncation(follow):
    logs, run = follow
    a = logs / "a.log"
    a.write_bytes(b"one\ntwo\n")
    assert run() == ["one", "two"]
    with a.open("ab") as f:
        f.write(b"three\n")
    a.rename(logs / "a.log.1")  # grown and renamed, and a new file in its place
    a.write_bytes(b"four\n")
    assert run() == sorted(["one", "two", "three", "four"])
    a.write_bytes(b"five\n")  # cut and written anew
    assert run() == sorted(["one", "two", "three", "four", "five"])
    with a.open("wb") as f:
        f.truncate(0)
    assert len(run()) == 5
    a.write_bytes(b"five\nsix\nseven\n")  # the same first line, but it had been cut in between
    assert run() == sorted(["one", "two", "three", "four", "five", "five", "six", "seven"])


def test_a_shorter_file_is_read_from_its_start():
    assert tail.ranges({"a": ["h", 90]}, {"a": ["h", 40]}) == [("a", "h", 0, 40)]
    assert tail.ranges({"a": ["h", 40]}, {"a": ["h", 40]}) == []
    assert tail.ranges({"a": ["h", 40]}, {"a.1": ["h", 60], "a": ["new", 5]}) == [("a", "new", 0, 5), ("a.1", "h", 40, 60)]
    assert tail.ranges({"a": ["h", 40]}, {"a": ["h", 50], "b": ["h", 60]}) == [("a", "h", 40, 50), ("b", "h", 0, 60)]
    assert tail.ranges({}, {"a": ["h", 3]}) == [("a", "h", 0, 3)] and tail.ranges({"a": ["h", 3]}, {}) == []


def test_renamed_between_plan_and_read(tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\nthree\n")
    reader = tail.TailReader(str(tmp_path), 5)
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    os.rename(tmp_path / "a", tmp_path / "a.1")
    (tmp_path / "a").write_bytes(b"other\n")
    got = [v for p in parts for b in reader.read(p) for v in b.column(2).to_pylist()]
    assert len(parts) == 3 and got == ["one", "two", "three"]


@pytest.mark.parametrize("size", [1, 2, 5, 64, 10_000])
def test_ranges_of_any_size_and_small_steps(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "STEP", 3)
    lines = [("l" * (i % 9)) + str(i) for i in range(120)]
    (tmp_path / "a").write_text("\n".join(lines) + "\npartial")
    reader = tail.TailReader(str(tmp_path), size)
    end = reader.latestOffset()
    rows = [(at, v) for p in reader.partitions({}, end) for b in reader.read(p) for at, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert [v for _, v in rows] == lines
    text = (tmp_path / "a").read_bytes()
    assert all(text[at:].startswith(v.encode() + b"\n") for at, v in rows)


def test_a_range_reads_little_more_than_its_bytes(tmp_path, monkeypatch):
    from pyarrow import fs

    line = b"x" * 99 + b"\n"
    (tmp_path / "a.log").write_bytes(line * 20_000)
    taken = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            data = self.f.read(n)
            taken.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    class System:
        def __getattr__(self, name):
            return getattr(fs.LocalFileSystem(), name)

        def open_input_file(self, path):
            return Counted(fs.LocalFileSystem().open_input_file(path))

    monkeypatch.setattr(tail, "_open", lambda folder: (System(), folder))
    reader = tail.TailReader(str(tmp_path), 64 << 10)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) == 31
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 20_000
    assert sum(taken) < 1.5 * 2_000_000
