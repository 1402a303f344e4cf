"""Filter interaction audit: which filter removes what, in every order, by an incremental stream with retractions.

All files are processed as available-now micro-batches. Python tasks turn a document into a mask of the filters that it
fails and the digest of its text; texts go no further. A keyed state holds the smallest id of each text so far and the
masks counted for it as a first copy. When a smaller id comes, what was counted is retracted and counted again with the
filter of copies added. Each batch's changes are summed by part, mask and labels and written under the batch's number, so
a batch that is run again replaces its own rows. Orders, steps and Shapley values follow from the 32 masks of a part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import common as C

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
COPY = BIT["E"]
_UPPER, _REST, _ODD = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), b"#$%&*|"
#: Bytes of a text that are split into words at a time, and bytes of text for each pass over its distinct words.
SLICE, PASS = 1 << 20, 8 << 20
#: Rows of a task among which copies are looked for before the state is asked.
LOCAL_ROWS = 1 << 15
DELTAS = "doc_id long, known boolean, part string, mask int, n long"
MASKS = f"key string, {DELTAS}"
#: Settings of the state store while the stream runs: state on disk instead of the heap, logs of changes instead of whole
#: files, and no disk set aside for stores that may be small.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Buckets of texts for each partition of the state.
BUCKETS = 8


def _slices(b: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about `size` bytes that end before white space; a longer word stays whole."""
    at = 0
    while at < len(b):
        to = at + size
        while to < len(b) and b[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield b[at:to]
        at = to


def words(b: bytes) -> tuple[int, int]:
    """(words, distinct words) of UTF-8 bytes. A long text is read in slices, and once more for every PASS bytes, so that
    only a share of its distinct words, chosen by their hash, is held at a time."""
    passes = 1 + len(b) // PASS
    total = distinct = 0
    for p in range(passes):
        seen: set[bytes] = set()
        for piece in _slices(b, SLICE):
            w = piece.split()  # of bytes: at space, \t \n \v \f \r
            total += len(w) if p == 0 else 0
            seen.update(w if passes == 1 else (x for x in w if hash(x) % passes == p))
        distinct += len(seen)
    return total, distinct


def mask(b: bytes) -> int:
    """Filters that a text fails by itself: A to D."""
    n, distinct = words(b)
    upper = points = 0
    odd = False
    for at in range(0, len(b), SLICE):
        x = b[at:at + SLICE]
        upper += len(x) - len(x.translate(None, _UPPER))
        points += len(x.translate(None, _REST))  # all bytes but those that continue a code point
        odd = odd or any(c in x for c in _ODD)
    return BIT["A"] * (n < 200) | BIT["B"] * (100 * distinct < 50 * n) | BIT["C"] * (100 * upper > 3 * points) | BIT["D"] * odd


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MASKS rows of documents (doc_id, part, text). Of rows with one text in a run of LOCAL_ROWS, those of the smallest id
    go on with the text's digest as key; the others are copies for certain and only pass through: their key is empty."""
    held: dict[str, tuple[int, Counter]] = {}  # smallest id of a text, and its rows by part and mask
    sure: list[tuple] = []
    nameless: Counter = Counter()  # rows without an id: no id is smaller
    rows = 0

    def flush():
        out = [(k, i, True, p, m, n) for k, (i, first) in held.items() for (p, m), n in first.items()] + sure + [("", 0, False, p, m, n) for (p, m), n in nameless.items()]
        for x in (held, sure, nameless):
            x.clear()
        cols = list(zip(*out)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64()))], ["key", "doc_id", "known", "part", "mask", "n"])

    for batch in batches:
        for doc, part, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part", "text")), strict=True):
            i, p, b = doc.as_py(), part.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b""
            m = mask(b)
            rows += 1
            if i is None:
                nameless[p, m] += 1
                continue
            key = hashlib.sha256(b).hexdigest()
            low, first = held.get(key, (i, Counter()))
            if i > low:
                sure.append(("", i, True, p, m | COPY, 1))
                continue
            if i < low:
                sure += [("", low, True, q, x | COPY, k) for (q, x), k in first.items()]
                first = Counter()
            first[p, m] += 1
            held[key] = (i, first)
        if rows >= LOCAL_ROWS:
            yield flush()
            rows = 0
    yield flush()


class _Retract(StatefulProcessor):
    """Changes (DELTAS) that new rows of a bucket of texts make. The state maps a text's digest to its smallest id and to
    what is counted for that; each entry is a row of the state store, only those of the texts that come are read. Buckets
    save calls into Python, which would cost far more than the work if each text were a group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "key string", "low long, held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        begun = self.texts.exists()
        for pdf in rows:
            out, here = [], {}
            for text, doc, known, part, m, n in zip(*(pdf[c].tolist() for c in ("key", "doc_id", "known", "part", "mask", "n")), strict=True):
                if not text:  # counted as it is
                    out.append((doc, known, part, m, n))
                    continue
                if text not in here:
                    old = self.texts.getValue((text,)) if begun else None
                    here[text] = [None, {}, False] if old is None else [old[0], {(p, x): k for p, x, k in json.loads(old[1])}, False]
                entry = here[text]
                low, first, _ = entry
                if low is not None and doc > low:
                    out.append((doc, True, part, m | COPY, n))
                    continue
                if low is not None and doc < low:
                    for (p, x), k in first.items():
                        out += [(low, True, p, x, -k), (low, True, p, x | COPY, k)]
                    first.clear()
                first[part, m] = first.get((part, m), 0) + n
                entry[0], entry[2] = doc, True
                out.append((doc, True, part, m, n))
            for text, (low, first, changed) in here.items():
                if changed:
                    self.texts.updateValue((text,), (low, json.dumps([[p, x, k] for (p, x), k in first.items()])))
            begun = begun or bool(here)
            yield pd.DataFrame(out, columns=["doc_id", "known", "part", "mask", "n"]).astype({"doc_id": "int64", "known": "bool", "mask": "int32", "n": "int64"})

    def close(self) -> None:
        pass


def counters(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """(part, mask, good, toxic, n): documents of a stream by part, filters failed, and labels, when all its files are done.

    docs: a stream with doc_id, text, lang (other columns are not used); labels: doc_id, quality, toxic. A null text is
    empty, a null lang the part ''. Rows that share an id count each; a row without an id fails no E and makes none fail.
    Several labels of an id count as their maximum. `folder` (default: a new one in the scratch folder) holds the stream's
    checkpoint and counters: called again with the same folder, only files that came since are processed.
    """
    spark = docs.sparkSession
    folder = folder or f"{C.scratch_dir(spark)}/audit"
    C.narrow_batches(spark)
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(_features, MASKS)
    buckets = F.lit(BUCKETS * C.partitions(spark))
    rows = rows.withColumn("bucket", F.pmod(F.when(F.col("key") != "", F.xxhash64("key")).otherwise(F.xxhash64("doc_id")), buckets))
    changes = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Retract(), outputStructType=DELTAS, outputMode="append", timeMode="None")

    def write(batch: DataFrame, number: int) -> None:
        by = batch.groupBy(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "part", "mask").agg(F.sum("n").alias("n")).where("n != 0")
        by = by.join(known, by["doc_id"] == known["id"], "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))
        by.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = changes.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _exists(spark, f"{folder}/counters"):
        return spark.createDataFrame([], "part string, mask int, good int, toxic int, n long")
    return spark.read.schema("part string, mask int, good int, toxic int, n long").parquet(f"{folder}/counters/batch=*").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def report(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from counters().

    A mask of k filters is removed by each of them in 120 / k of the orders, so a filter's Shapley sum needs no orders.
    """
    steps = []
    for order in itertools.permutations(FILTERS):
        done = 0
        for i, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(done).alias("before"), F.lit(BIT[f]).alias("bit")))
            done |= BIT[f]
    n = F.col("n")
    small = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))
    each = small.withColumn("s", F.explode(F.array(*steps))).select("part", "mask", "n", "good", "toxic", "s.*")
    mask_, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask_.bitwiseAND(bit) != 0, mask_.bitwiseAND(before) != 0
    total = lambda cond, what=n: F.sum(F.when(cond, what).otherwise(0)).cast("long")
    share = n * F.expr("120 div greatest(bit_count(mask), 1)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(mask_ == bit).alias("unique_fails"),
        total(fails & ~gone, F.col("good")).alias("good_lost"), total(fails & ~gone, F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """report() of counters(): every part, all 120 orders, 5 steps; no document gives no rows."""
    return report(counters(docs, labels, folder))


def stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Documents of a folder (or file) of Parquet as a stream of at most so many files a batch. Every batch joins its
    changes to the labels and commits the state, so a batch should hold many files."""
    files = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
