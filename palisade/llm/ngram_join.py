"""N-gram Jaccard join of documents: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct N-word shingles (64-bit hashes). Shingles are ordered by how often they occur
(counted over all documents in a sketch of fixed size, ties by hash: any order is right, a rare-first one is fast).
Two sets with Jaccard >= t share one of their first n - ceil(t n) + 1 shingles, so documents meet on those prefixes.

Documents that share a prefix shingle are first compared with one document each (the smallest id): in a group of
copies that links all of them with as many comparisons as copies. Only documents that are still in different
components are then compared with each other, so no link between different sets is lost, and a pair of sets is verified
once. There the smaller set of a pair meets the larger one in its first n - ceil(2 t n / (1 + t)) + 1 shingles, which
keeps documents of one template whose own parts are too long for a link from meeting at all.

A shingle that the sketch counts more than HOT times is dealt out by shingle and document; the first documents of its
parts are then compared with the first of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SKETCH_BITS, PARTS, RANGES = 18, 64, 64
#: Rows of one shingle (or of one shingle and size class) that one task may get.
HOT = 1 << 16
PASS1 = "doc_id long, n long, s1 long, s2 long, ranges binary, part int, counts binary"


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash), distinct and sorted by text. A text of fewer than n words is one shingle of all its words."""
    raw = C.LOWER[raw]
    starts, stops, before = C.word_spans(raw, offsets)
    w = C.word_hashes(raw, starts, stops)
    words = np.diff(before)
    row = np.repeat(np.arange(len(words)), words)
    mult = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1F123BB5159A55E5 & 0xFFFFFFFFFFFFFFFF | 1) for k in range(n)]
    rows, keys = [], []
    if len(w) >= n:
        h = w[: len(w) - n + 1] * mult[0]
        for k in range(1, n):
            h = h + w[k: len(w) - n + 1 + k] * mult[k]
        same = row[: len(h)] == row[n - 1:]
        rows.append(row[: len(h)][same])
        keys.append(C.mix(h[same]))
    for i in np.flatnonzero((words > 0) & (words < n)):
        h = np.uint64(words[i])
        with np.errstate(over="ignore"):
            for k, v in enumerate(w[before[i]:before[i + 1]]):
                h = h + v * mult[k]
        rows.append(np.array([i]))
        keys.append(C.mix(np.array([h], np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _needed(a, b, percent: int):
    """Least intersection of sets of a and b elements with Jaccard >= percent / 100, in whole numbers."""
    return -(-percent * (a + b) // (100 + percent))


def _summaries(n: int):
    """By document: set size, two 64-bit checksums of the set and counts by range of the hash; by task: the sketch."""
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part, raw, offsets in C.chunks(batch):
                m = part.num_rows
                row, key = shingles(raw, offsets, n)
                size = np.bincount(row, minlength=m)
                s1, s2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
                at = np.cumsum(size) - size
                some = size > 0
                if len(key):
                    s1[some] = np.add.reduceat(C.mix(key), at[some])
                    s2[some] = np.bitwise_xor.reduceat(C.mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[some])
                total += np.bincount((key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                per = np.bincount(row * RANGES + (key & np.uint64(RANGES - 1)).astype(np.int64), minlength=m * RANGES)
                per = np.minimum(per, 65535).astype(np.uint16)
                yield _rows([part.column(part.schema.get_field_index("doc_id")), size, s1.view(np.int64), s2.view(np.int64), C.packed(per, np.arange(m + 1) * RANGES), None, None], m)
        width = len(total) // PARTS
        yield _rows([None] * 5 + [np.arange(PARTS, dtype=np.int32), C.packed(np.minimum(total, 2**31 - 1).astype(np.int32), np.arange(PARTS + 1) * width)], PARTS)
    return run


_KINDS = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]


def _rows(columns, n: int) -> pa.RecordBatch:
    arrays = [pa.nulls(n, k) if c is None else (c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k in zip(columns, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PASS1.split(", ")])


def _add_up(batches):
    """Sum of sketches, part by part; the parts of this task are all it holds."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(v, np.int32).astype(np.int64)
            sums[k] = sums[k] + x if k in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])


def _prefixes(n: int, percent: int, sketch, hot: int):
    """(token, salt, doc_id, n | position) for the prefix shingles of each document; of equal sets in one task, the first
    only. salt is 0 unless the shingle is a frequent one."""
    def run(batches):
        counts, seen = sketch.value, set()
        for batch in batches:
            for part, raw, offsets in C.chunks(batch):
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                row, key = shingles(raw, offsets, n)
                size = np.bincount(row, minlength=len(ids))
                mark = np.zeros(len(ids), np.uint64)
                at = np.cumsum(size) - size
                if len(key):
                    mark[size > 0] = np.add.reduceat(C.mix(key), at[size > 0])
                fresh = np.ones(len(ids), bool)
                for i, k in enumerate(mark.tolist()):
                    fresh[i] = k not in seen
                    seen.add(k)
                order = np.lexsort((key, counts[(key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
                row, key = row[order], key[order]
                pos = np.arange(len(row)) - at[row]
                first = (pos < size[row] - _needed_self(size[row], percent) + 1) & fresh[row]
                row, key, pos = row[first], key[first], pos[first]
                parts = counts[(key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // hot + 1
                salt = np.where(parts > 1, C.mix(ids[row].astype(np.int64).view(np.uint64)) % parts.astype(np.uint64) + np.uint64(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(ids[row], pa.int64()), pa.array((size[row] << 16) | np.minimum(pos, 65535))], names=["token", "salt", "doc_id", "np"])
    return run


def _needed_self(n, percent: int):
    return -(-percent * n // 100)


def _may(na, pa_, nb, pb, percent: int):
    """Length and positional filter: can sets of these sizes, meeting at these positions, still reach the threshold?"""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * low >= percent * high) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= _needed(na, nb, percent))


GROUP = "token long, salt int, doc_id long, np long, hub long, may boolean"


def _groups(percent: int):
    """Rows of tokens that two documents share, with the first document of the token and whether the two may link.

    Input is sorted by token, salt and doc_id; one row is carried from batch to batch, so a token may be of any size.
    Rows with a salt are all returned, as another part of the token may hold its other documents.
    """
    def run(batches):
        last = None  # token, salt, hub id, hub np, whether the hub's own row is still to be written
        for batch in batches:
            t, s, d, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(t):
                continue
            if last is not None:
                t, s, d, v = (np.append(np.array(x, y.dtype), y) for x, y in zip(last, (t, s, d, v)))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(new)
            hub = at[np.cumsum(new) - 1]
            count = np.diff(np.append(at, len(t)))
            out = (count > 1)[np.cumsum(new) - 1]
            out |= s > 0
            if last is not None and last[4]:
                out[0] = False  # written with an earlier batch
            may = _may(v[hub] >> 16, v[hub] & 65535, v >> 16, v & 65535, percent) & (d != d[hub])
            last = (t[hub[-1]], s[hub[-1]], d[hub[-1]], v[hub[-1]], bool(count[-1] > 1 or s[-1] > 0))
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(s[out]), pa.array(d[out]), pa.array(v[out]), pa.array(d[hub][out]), pa.array(may[out])], names=["token", "salt", "doc_id", "np", "hub", "may"])
    return run


def _pack(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part, raw, offsets in C.chunks(batch):
            data = memoryview(np.ascontiguousarray(raw))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array([press.compress(data[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())], names=["doc_id", "z"])


def _verify(n: int, percent: int):
    """Exact test of each pair on whole sets; the sets of the document that is kept in place are made once."""
    def run(batches):
        un = zstandard.ZstdDecompressor()
        held: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))

        def make(z: bytes) -> np.ndarray:
            raw = np.frombuffer(un.decompress(z), np.uint8)
            return shingles(raw, np.array([0, len(raw)]), n)[1]

        for batch in batches:
            a, b, za, zb = (batch.column(k) for k in range(4))
            ids_a, ids_b = a.to_pylist(), b.to_pylist()
            ok = np.zeros(len(ids_a), bool)
            for i, (x, y) in enumerate(zip(ids_a, ids_b, strict=True)):
                if held[0] != y:
                    held = (y, make(zb[i].as_py()))
                other, mine = make(za[i].as_py()), held[1]
                at = np.searchsorted(mine, other)
                both = int((mine[np.minimum(at, len(mine) - 1)] == other).sum()) if len(mine) and len(other) else 0
                ok[i] = 100 * both >= percent * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids_a, np.int64)[ok]), pa.array(np.array(ids_b, np.int64)[ok])], names=["a", "b"])
    return run


def jaccard_components(docs: DataFrame, shingle_words: int = 4, percent: int = 85, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: documents link at Jaccard >= percent / 100.

    A text without words, or null, has an empty set and links with nothing. doc_id should be unique and not null;
    rows that repeat an id count as that one document, a null id forms a row of its own with component null. `hot` is the
    number of rows of one shingle above which they are spread over tasks.
    """
    spark = docs.sparkSession
    C.narrow_batches(spark)
    n_parts = C.partitions(spark)
    texts = C.with_text_only(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    seen = C.save(texts.mapInArrow(_summaries(shingle_words), PASS1), "sets")
    sketch = seen.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(_add_up, "part int, counts binary").collect()  # 2^18 counts, whatever the input
    sums = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in sketch}
    width = (1 << SKETCH_BITS) // PARTS
    shared = spark.sparkContext.broadcast(np.concatenate([sums.get(k, np.zeros(width, np.int64)) for k in range(PARTS)]))
    sets = seen.where("part is null").select("doc_id", "n", "s1", "s2", "ranges")
    # only sets that occur twice are joined back, so that all copies of one text need not meet in one task
    full = sets.where("n > 0 and doc_id is not null")
    reps = full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    reps = C.small(C.save(reps, "copies"))
    of = full.join(reps, ["n", "s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    of = C.save(of.select("doc_id", "rep", "n", F.when(F.col("doc_id") == F.col("rep"), F.col("ranges")).alias("ranges")), "classes")
    rows = texts.where("doc_id is not null").mapInArrow(_prefixes(shingle_words, percent, shared, hot), "token long, salt int, doc_id long, np long")
    rows = rows.repartition(n_parts, "token", "salt").sortWithinPartitions("token", "salt", "doc_id")
    groups = C.save(rows.mapInArrow(_groups(percent), GROUP), "groups")
    met = groups.where("may").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    if shared.value.max() > hot:
        hubs = groups.where("salt > 0 and doc_id = hub").select("token", F.lit(0).alias("salt"), "doc_id", "np").distinct()
        hubs = hubs.repartition(n_parts, "token").sortWithinPartitions("token", "doc_id").mapInArrow(_groups(percent), GROUP)
        met = met.unionByName(hubs.where("may").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))

    busy = groups.select("doc_id").distinct().join(of.select("doc_id", "rep"), "doc_id").select(F.col("rep").alias("doc_id")).distinct()
    packed = texts.where("doc_id is not null").mapInArrow(_pack, "doc_id long, z binary")
    packed = C.save(packed.join(busy, "doc_id", "left_semi"), "texts")
    ids, ranges = of.select("doc_id", "rep"), of.where("ranges is not null").select(F.col("doc_id").alias("rep"), "n", "ranges")

    def pairs(found: DataFrame) -> DataFrame:
        """Distinct pairs of classes, a < b."""
        p = found.select("a", "b").distinct()
        p = p.join(ids.withColumnRenamed("doc_id", "a").withColumnRenamed("rep", "ra"), "a").join(ids.withColumnRenamed("doc_id", "b").withColumnRenamed("rep", "rb"), "b")
        return p.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    def verified(p: DataFrame, name: str) -> DataFrame:
        """Those that pass the suffix filter (counts by hash range bound the intersection) and then the exact test."""
        p = p.join(ranges.toDF("a", "na", "ka"), "a").join(ranges.toDF("b", "nb", "kb"), "b").mapInArrow(_suffix_filter(percent), "a long, b long")
        both = p.join(packed.toDF("a", "za"), "a").join(packed.toDF("b", "zb"), "b")
        return C.save(both.select("a", "b", "za", "zb").mapInArrow(_verify(shingle_words, percent), "a long, b long"), name)

    tried = C.save(pairs(met), "tried")
    stars = verified(tried, "stars")
    comp = C.save(components(stars), "star_components")
    # what is left: documents of different components under one token, in size classes that a link cannot skip
    left = groups.join(ids, "doc_id").select("token", F.col("rep").alias("doc_id"), "np").distinct()
    left = left.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component_id", "doc_id")).drop("component_id")
    mixed = left.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    left = C.save(left.join(mixed, "token").withColumns({"n": F.shiftright("np", 16), "pos": F.col("np").bitwiseAND(F.lit(65535))}).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")), "left")
    # the smaller set of a pair meets in its short prefix; hot keys are dealt out by a salt of the smaller set
    short = left.where(F.lit(100 + percent) * (F.col("n") - F.col("pos")) >= F.lit(2 * percent) * F.col("n"))
    many = short.groupBy("token", "size").count().where(F.col("count") > hot)
    many = C.small(C.save(many.select("token", "size", F.floor(F.col("count") / hot).cast("int").alias("parts")), "hot"))
    one = short.join(many, ["token", "size"], "left").select("token", "size", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts") + 1), F.lit(0)).cast("int").alias("salt"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    two = left.select("token", F.explode(F.array(F.col("size") - 1, F.col("size"))).alias("size"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    two = two.join(many, ["token", "size"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(0))))).drop("parts")
    may = (F.col("ca") != F.col("cb")) & (F.col("na") <= F.col("nb")) & (F.lit(100) * F.col("na") >= F.lit(percent) * F.col("nb")) & (F.lit(100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(percent) * (F.col("na") + F.col("nb")))
    rest = one.join(two, ["token", "size", "salt"]).where(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = verified(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    comp = components(stars.unionByName(more))
    for done in (left, groups, packed):  # the largest scratch tables; nothing below reads them
        C.discard(done)
    linked = of.select("doc_id", F.col("rep").alias("id")).join(comp, "id", "left").select(F.col("doc_id").alias("_d"), F.coalesce("component_id", "id").alias("_c")).distinct()
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(linked, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))


def _suffix_filter(percent: int):
    def run(batches):
        for batch in batches:
            col = lambda k: batch.column(batch.schema.get_field_index(k))
            na, nb = (col(k).to_numpy(zero_copy_only=False) for k in ("na", "nb"))
            if not len(na):
                continue
            ka, kb = (np.frombuffer(C.flat(col(k))[0].tobytes(), np.uint16).reshape(-1, RANGES).astype(np.int64) for k in ("ka", "kb"))
            ok = (np.minimum(ka, kb).sum(1) >= _needed(na, nb, percent)) | (ka.max(1) == 65535) | (kb.max(1) == 65535)
            yield pa.RecordBatch.from_arrays([col("a"), col("b")], names=["a", "b"]).filter(pa.array(ok))
    return run


def representative(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their component; a row with a null id stays."""
    later = jaccard_components(docs, shingle_words, percent).where(F.col("doc_id") != F.col("component_id"))
    return C.without(docs, later)
