"""Helpers shared by the operators: tables, scratch tables, and vectorised work on UTF-8 bytes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once inside a task; bounds numpy's memory.
CHUNK = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are wide, and every Python worker holds a few copies of a batch.
BATCH_ROWS = 500


def narrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Folders made inside tidy(), the innermost last.
_made: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder named by spark.checkpoint.dir.

    A local folder is used only if that is unset and the master is this machine alone (tests).
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file:///tmp/spark-scratch"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def tidy(spark: SparkSession):
    """Delete, at the end, the scratch folders made inside, and restore the Arrow batch size. Gives a save() whose
    table stays."""
    def keep(df: DataFrame, name: str) -> DataFrame:
        out = save(df, name)
        _made[-1].pop()  # the folder of that table: nothing is made while it is written
        return out

    _made.append([])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        yield keep
    finally:
        spark.conf.set(key, before)
        for path in _made.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table of ids or other narrow rows (at most some 50 bytes each) is broadcast.
SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The narrow table `df` (read from a file) with a broadcast hint if it has few rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in `ids`; rows with a null id stay. Texts are only shuffled if the ids are many."""
    return docs.join(small(save(ids.select("doc_id").distinct(), "ids")), "doc_id", "left_anti")


def discard(df: DataFrame) -> None:
    """Delete a table written by save() that nothing will read again."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def fresh(df: DataFrame, name: str) -> str:
    """`name` with as many underscores in front as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n: the split of learning and held-out rows."""
    return F.crc32(col.cast("string").cast("binary")) % n


def share(spark: SparkSession, rows: int, bound: int) -> float:
    """Share of rows to sample so that about `bound` rows come back."""
    return 1.0 if rows <= bound else bound / rows


def by_hash(col: Column, part: float, seed: int = 7) -> Column:
    """A repeatable Bernoulli sample: hash of the id below a threshold."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))


# --- UTF-8 columns as flat bytes -------------------------------------------------------------

def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK):
    """(slice of the batch, its bytes, its offsets), each of about `limit` bytes; a longer text comes alone."""
    raw, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers = np.cumprod(np.concatenate([[_U(1)], np.full((1 << 16) - 1, _P)]), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _P)]), dtype=np.uint64)
    return _powers[:n]


def word_spans(raw: np.ndarray, offsets: np.ndarray, ends: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text (length: texts + 1)."""
    inside = ~ends[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    within = np.arange(total) - np.repeat(begin, sizes)
    at = within + np.repeat(starts, sizes)
    values = (raw[at].astype(np.uint64) + _U(1)) * powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(values, begin) + sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def with_text_only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; text as binary."""
    return docs.select(*names, F.col("text").cast("binary").alias("text"))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of values; counts may hold zeros."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return c[ends] - c[ends - counts]


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[at[i]:at[i + 1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
