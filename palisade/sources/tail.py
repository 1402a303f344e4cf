"""A streaming source of log lines that follows growing and rotated files by byte position.

An offset is a snapshot of the folder: for each file, a digest of its first line and the position after its last whole
line. A batch reads what lies between two snapshots, cut into byte ranges that are tasks of their own. A file is the same
if it begins with the same line: one that has been renamed goes on where it was, one that has become shorter or begins
with another line is read from its start. A line without its end waits for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes read at a time, at most; short reads begin with FIRST and double.
STEP = 1 << 20
FIRST = 1 << 12


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _head(f) -> str | None:
    """Digest of the first line; None as long as it has no end."""
    f.seek(0)
    digest, step = hashlib.md5(usedforsecurity=False), FIRST
    while data := f.read(step):
        line, end, _ = data.partition(b"\n")
        digest.update(line)
        if end:
            return digest.hexdigest()
        step = min(2 * step, STEP)
    return None


def _last_end(f, size: int) -> int:
    """Position after the last line end."""
    at, step = size, FIRST
    while at > 0:
        begin = max(0, at - step)
        f.seek(begin)
        found = f.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at, step = begin, min(2 * step, STEP)
    return 0


def snapshot(folder: str, before: dict | None = None) -> dict[str, list]:
    """{name: [head, end]} of the files of a folder that have a whole line. Names that begin with "." or "_" are not read.
    A file's end is looked for only if it has grown since `before`."""
    from pyarrow import fs

    system, root = _open(folder)
    out = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and info.size and info.base_name[0] not in "._":
            with system.open_input_file(info.path) as f:
                head = _head(f)
                if head is not None:
                    old = (before or {}).get(info.base_name)
                    same = old and old[0] == head and old[1] == info.size
                    out[info.base_name] = [head, info.size if same else _last_end(f, info.size)]
    return out


def ranges(start: dict, end: dict) -> list[tuple[str, str, int, int]]:
    """(name, head, from, to): the bytes that `end` has and `start` has not."""
    free: dict[str, list[int]] = {}  # positions of files that are gone from their names, by head
    for name, (head, at) in sorted(start.items()):
        if name not in end or end[name][0] != head or end[name][1] < at:
            free.setdefault(head, []).append(at)
    out = []
    for name, (head, to) in sorted(end.items()):
        old = start.get(name)
        if old and old[0] == head and old[1] <= to:
            at = old[1]
        else:  # renamed, if a file that began like this has gone and was no longer than this one
            moved = [a for a in free.get(head, []) if a <= to and not (old and old[0] == head)]
            at = max(moved, default=0)
            if moved:
                free[head].remove(at)
        if at < to:
            out.append((name, head, at, to))
    return out


class Range(InputPartition):
    """Lines of a file that begin at `at` or later and before `to`; `begin` is where a line begins for certain."""

    def __init__(self, name: str, head: str, begin: int, at: int, to: int):
        self.name, self.head, self.begin, self.at, self.to = name, head, begin, at, to


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size, self.seen = folder, size, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = snapshot(self.folder, self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(name, head, at, b, min(b + self.size, to)) for name, head, at, to in ranges(start, end) for b in range(at, to, self.size)]

    def _file(self, system, root: str, part: Range):
        """The file that begins with the head: under its name, or, when it was renamed meanwhile, under another."""
        from pyarrow import fs

        names = [f"{root}/{part.name}", *sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File)]
        for path in names:
            if system.get_file_info(path).type != fs.FileType.File:
                continue
            f = system.open_input_file(path)
            if _head(f) == part.head and f.size() >= part.to:
                return f
            f.close()
        raise FileNotFoundError(f"{self.folder}/{part.name} has been removed or cut before it was read")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.folder)
        with self._file(system, root, partition) as f:
            at, rest = partition.at, b""
            if at > partition.begin:  # the line that goes on here belongs to the range before
                at -= 1
                f.seek(at)
                step = FIRST
                while True:
                    data = f.read(step)
                    step = min(2 * step, STEP)
                    found = data.find(b"\n")
                    at += found + 1 if found >= 0 else len(data)
                    if found >= 0 or not data:
                        break
            f.seek(at)
            where, step = at, FIRST
            while where < partition.to:
                left = partition.to - where - len(rest)  # beyond the range only the end of its last line is read
                more = f.read(min(left, STEP) if left > 0 else step)
                step = step if left > 0 else min(2 * step, STEP)
                data = rest + more
                if not more:
                    break
                *lines, rest = data.split(b"\n")
                places, texts = [], []
                for line in lines:
                    if where >= partition.to:
                        break
                    places.append(where)
                    texts.append(line.removesuffix(b"\r").decode(errors="replace"))
                    where += len(line) + 1
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(texts)), pa.array(places, pa.int64()), pa.array(texts)], ["file", "at", "value"])


class Tail(DataSource):
    """spark.dataSource.register(Tail); spark.readStream.format("log_tail").option("path", folder).load()

    Rows are (file, at, value): the name a line was read under, its first byte, and its text without line ends (bytes that
    are no UTF-8 are replaced). The folder is a local or shared path, or a URI of a store that pyarrow reaches. Option
    range_bytes (32 MB): bytes of a task. A file that goes and comes back after a batch in between is read again, and of two
    files that begin with the same line one may be taken for the other when both are renamed in the same batch.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], int(self.options.get("range_bytes", 32 << 20)))
