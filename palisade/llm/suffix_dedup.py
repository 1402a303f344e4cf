"""Suffix-array dedup: remove every byte that lies in a 100-byte string which also starts earlier.

Positions. Of the GRAM-byte strings in each 100-byte window the one of least hash (leftmost at ties) is the window's
anchor, so equal windows have equal anchors at equal offsets, and only suffixes that begin at anchors need be compared.
An anchor owns a run of consecutive windows; its owned bytes are those of these windows. There is about one anchor in
27 bytes, and a text of any length is worked through in pieces.

Stage 1. Anchors are grouped by the hash of their GRAM bytes (their head); only documents' heads that occur more than
once go on. The hash decides what is looked at, never what is removed.
Stage 2. Suffixes at those anchors travel with their bytes. Splitters sampled from leading bytes range-partition them:
partition i holds the suffixes between splitters i - 1 and i. Partitions are sorted by suffix bytes; suffixes that are
equal (with the bytes before them in the window) are neighbours, also across the batches in which a partition is read,
and all but the earliest are removed whole. Of suffixes that share a head and differ, all owned windows are sorted by
multikey quicksort, and neighbours that agree on 100 bytes mark the later one.
Stage 3. Removed runs are merged by document and cut out.

Frequent heads. A head in a hundredth of the sampled documents, or with more than HOT anchors, is never one task's
group: its windows are rows of their own, dealt by a hash of all their 100 bytes and compared with their neighbours in
sorted order. Before any of that, equal owned bytes are folded inside each map task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WIDTH, GRAM = 100, 48
SPAN = WIDTH - GRAM  # an anchor lies 0..SPAN bytes after the start of its window
#: Anchors of a head beyond which its windows are spread out; bounds what a task holds of one head.
HOT = 2048
#: Suffixes whose windows are sorted at once inside a task (a head is never cut); bounds numpy's memory.
SLICE = 512
#: Different owned bytes that a map task folds at once (about 300 bytes each); beyond, they are sent on unfolded.
FOLD = 20_000
#: Leading bytes of a suffix that splitters compare.
LEAD = 24
_U = np.uint64
_MARK = 1 << 40  # count of a head that the sample has found to be frequent
_INV = pow(int(C._P), -1, 1 << 64)
_inverse = np.cumprod(np.concatenate([[_U(1)], np.full((1 << 12) - 1, _U(_INV))]), dtype=np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse
    if n > len(_inverse):
        _inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_INV))]), dtype=np.uint64)
    return _inverse[:n]


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """(text, anchor, first window, last window, head) of some texts, in order; positions are in `raw`.

    Texts of fewer than WIDTH bytes have none.
    """
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < WIDTH:
        return none, none, none, none, none.astype(np.uint64)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * C.powers(n), out=pre[1:])
    h = C.mix((pre[GRAM:] - pre[:-GRAM]) * _inverses(n - GRAM + 1))
    # least of SPAN + 1 neighbours and its place, by doubling; the left one wins ties
    best, owner, have = h, np.arange(len(h)), 1
    while have < SPAN + 1:
        step = min(have, SPAN + 1 - have)
        right = best[step:] < best[:-step]
        best, owner = np.where(right, best[step:], best[:-step]), np.where(right, owner[step:], owner[:-step])
        have += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[: n - WIDTH + 1] == row[WIDTH - 1:])
    if not len(start):
        return none, none, none, none, none.astype(np.uint64)
    owner = owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, anchor = start[at], start[np.append(at[1:], len(start)) - 1], owner[at]
    return row[first], anchor, first, last, h[anchor]


def pieces(raw: np.ndarray, offsets: np.ndarray):
    """anchors() of texts; a long one is worked through in pieces that overlap by less than a window."""
    if len(offsets) > 2 or len(raw) <= 2 * C.CHUNK:
        yield anchors(raw, offsets)
        return
    for s in range(0, len(raw), C.CHUNK):
        part = raw[s:s + C.CHUNK + WIDTH - 1]
        row, anchor, first, last, h = anchors(part, np.array([0, len(part)]))
        yield row, anchor + s, first + s, last + s, h


def sample(texts: DataFrame, parts: int, sample_rows: int = 2000, per_row: int = 4096, lead_rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, frequent heads) from about sample_rows texts chosen by a hash of the id.

    parts - 1 splitters are quantiles of the first LEAD bytes of at most lead_rows suffixes a text; heads are frequent
    in at least a hundredth of the texts (and four). Of a text at most per_row heads, those of least hash, are looked at.
    """
    def run(batches):
        for batch in batches:
            for part, raw, offsets in C.chunks(batch):
                for row, anchor, _, _, h in pieces(raw, offsets):
                    for r in np.unique(row):
                        mine = np.flatnonzero(row == r)
                        _, one = np.unique(h[mine], return_index=True)
                        mine = mine[one[:per_row]]
                        lead = raw[anchor[mine[:lead_rows], None] + np.arange(LEAD)]
                        yield pa.RecordBatch.from_arrays([pa.array([h[mine].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(lead).tobytes()], pa.binary())], names=["h", "k"])

    chosen = texts.where(C.by_hash(F.col("doc_id"), C.share(texts.sparkSession, texts.count(), sample_rows)))
    got = chosen.mapInArrow(run, "h binary, k binary").collect()
    if not got:
        return np.zeros(0, f"S{LEAD}"), np.zeros(0, np.uint64)
    heads, many = np.unique(np.concatenate([np.frombuffer(r["h"], np.uint64) for r in got]), return_counts=True)
    keys = np.sort(np.concatenate([np.frombuffer(r["k"], f"S{LEAD}") for r in got]))
    return np.unique(keys[(np.arange(1, parts) * len(keys)) // parts]), heads[many >= max(4, len(got) // 100)]


def _inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _heads(frequent):
    """(h, doc_id, m): heads of each document with their number; m is _MARK for frequent ones."""
    def run(batches):
        known = frequent.value
        for batch in batches:
            for part, raw, offsets in C.chunks(batch):
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                for row, _, _, _, h in pieces(raw, offsets):
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    at = np.flatnonzero(new)
                    m = np.diff(np.append(at, len(h)))
                    m[_inside(h[at], known)] = _MARK
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[row[at]], pa.int64()), pa.array(m, pa.int64())], names=["h", "doc_id", "m"])
    return run


HEAD = "doc_id long, h long, hot boolean"


def _repeated(batches):
    """Rows sorted by head -> the documents of heads that occur more than once; a row without doc_id for each head of
    more than HOT anchors. Of the head that is still open only its count, and the first row while it is alone, are kept."""
    open_, total, alone = None, 0, None

    def rows(doc, h, hot):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(hot, pa.bool_())], names=["doc_id", "h", "hot"])

    for batch in batches:
        h, doc, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        known = m >= _MARK
        if known.any():
            yield rows(doc[known], h[known], np.ones(int(known.sum()), bool))
            h, doc, m = h[~known], doc[~known], m[~known]
        if not len(h):
            continue
        at = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        size = np.add.reduceat(m, at)
        if open_ is not None and h[0] == open_:
            size[0] += total
            if alone is not None and size[0] > 1:
                yield rows([alone], [open_], [False])
                alone = None
        elif total > HOT:
            yield rows([None], [open_], [True])
        closed = size[:-1] > HOT
        if closed.any():
            yield rows([None] * int(closed.sum()), h[at[:-1][closed]], np.ones(int(closed.sum()), bool))
        go = np.repeat(size > 1, np.diff(np.append(at, len(h))))
        yield rows(doc[go], h[go], np.zeros(int(go.sum()), bool))
        alone = doc[-1] if size[-1] == 1 else None
        open_, total = h[-1], int(size[-1])
    if total > HOT:
        yield rows([None], [open_], [True])


#: part: partition; k: suffix from the anchor on, or a window; left: the bytes before the anchor, null for a window.
#: Rows without k are removed runs from `at` to `to`.
SUFFIX = "part int, k binary, left binary, doc_id long, nth int, at long, to long"


def _suffix_rows(part, k, left, doc, nth, at, to) -> pa.RecordBatch:
    n = len(part)
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    cols = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip((part, k, left, doc, nth, at, to), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SUFFIX.split(", ")])


def _suffixes(splitters, parts: int):
    """Packed texts with the heads asked for -> suffixes at those anchors, equal ones folded to the earliest.

    What is folded depends on the order of the rows only, which is sorted by document, so a task that is run again
    gives the same rows.
    """
    def out(held: dict):
        cut = splitters.value
        cold = [(key, *v) for key, v in held.items() if not v[3]]
        if cold:
            k, left = [c[0][c[0][-1]:-1] for c in cold], [c[0][:c[0][-1]] for c in cold]
            part = np.searchsorted(cut, np.array([x[:LEAD] for x in k], f"S{LEAD}"), "right")
            yield _suffix_rows(part, k, left, [c[1] for c in cold], [c[2] for c in cold], [c[3] for c in cold], None)
        hot = [(key, *v) for key, v in held.items() if v[3]]
        for lo in range(0, len(hot), 2 * SLICE):
            some = hot[lo:lo + 2 * SLICE]
            raw = np.frombuffer(b"".join(c[0] for c in some), np.uint8)
            size = np.array([len(c[0]) for c in some])
            count = size - WIDTH  # the last byte is no text
            which = np.repeat(np.arange(len(some)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            win = np.zeros((len(which), WIDTH + 4), np.uint8)
            win[:, :WIDTH] = raw[((np.cumsum(size) - size)[which] + nth)[:, None] + np.arange(WIDTH)]
            mark = C.mix((C.mix(win.view(np.uint64)) * C.powers(win.shape[1] // 8)).sum(1, dtype=np.uint64))
            k = pa.Array.from_buffers(pa.binary(), len(win), [None, pa.py_buffer((np.arange(len(win) + 1) * WIDTH).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(win[:, :WIDTH]))])
            yield _suffix_rows((mark % _U(parts)).astype(np.int32), k, None, np.array([c[1] for c in some])[which], np.array([c[2] for c in some], np.int32)[which], np.array([c[3] for c in some])[which] + nth, None)

    def run(batches):
        held: dict[bytes, tuple] = {}
        for docs in _texts(batches):
            raw = b"".join(d[2] for d in docs)
            flat = np.frombuffer(raw, np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])])
            salt = lambda i: C.mix(np.asarray(i).astype(np.uint64) + _U(1))
            keys = np.concatenate([d[3].view(np.uint64) ^ salt(np.full(len(d[3]), i)) for i, d in enumerate(docs)])
            order = np.argsort(keys)
            keys, flags = keys[order], np.concatenate([d[4] for d in docs])[order]
            gone = []
            for row, anchor, first, last, h in pieces(flat, offsets):
                mine = h ^ salt(row)
                hit = np.flatnonzero(_inside(mine, keys))
                flag = flags[np.minimum(np.searchsorted(keys, mine[hit]), len(keys) - 1)]
                for r, p, a, b, f in zip(row[hit].tolist(), anchor[hit].tolist(), first[hit].tolist(), last[hit].tolist(), flag.tolist(), strict=True):
                    key = raw[a:b + WIDTH] + bytes((p - a,))
                    new = (docs[r][0], docs[r][1], a - int(offsets[r]), f)
                    old = held.get(key)
                    if old is None or new[:3] < old[:3]:
                        held[key] = new
                    if old is not None:
                        gone.append((*max(new[:3], old[:3]), len(key) - 1))
            if gone:
                d, t, s, n = (np.array(x, np.int64) for x in zip(*gone, strict=True))
                d, t, s, e = merged([d, t], s, s + n)
                yield _suffix_rows((C.mix(d.view(np.uint64)) % _U(parts)).astype(np.int32), None, None, d, t.astype(np.int32), s, e)
            if len(held) > FOLD:
                yield from out(held)
                held = {}
        yield from out(held)
    return run


def _texts(batches):
    """Lists of (doc_id, nth, text, heads, flags) of about CHUNK bytes; a longer text comes alone."""
    un, docs, size = zstandard.ZstdDecompressor(), [], 0
    for batch in batches:
        doc, nth, z = (batch.column(k) for k in range(3))
        for i, (h, hot) in enumerate(lists(batch.column(3))):
            text = un.decompress(z[i].as_py())
            if docs and size + len(text) > C.CHUNK:
                yield docs
                docs, size = [], 0
            docs.append((doc[i].as_py(), nth[i].as_py(), text, h, hot))
            size += len(text)
    if docs:
        yield docs


def merged(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray):
    """Runs of each document (named by `keys`), sorted, with those that overlap or touch joined."""
    if not len(start):
        return *keys, start, end
    order = np.lexsort((start, *keys[::-1]))
    keys, start, end = [k[order] for k in keys], start[order], end[order]
    other = np.ones(len(start), bool)
    other[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    # running maximum within a document: documents are lifted above each other
    lift = np.cumsum(other).astype(np.int64) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + lift) - lift
    new = other.copy()
    new[1:] |= start[1:] > top[:-1]
    at = np.flatnonzero(new)
    return *[k[at] for k in keys], start[at], top[np.append(at[1:], len(start)) - 1]


RUN = "doc_id long, nth int, first long, last long"


def _runs(doc, nth, start, end) -> pa.RecordBatch:
    d, t, s, e = merged([np.asarray(doc, np.int64), np.asarray(nth, np.int64)], np.asarray(start, np.int64), np.asarray(end, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t.astype(np.int32)), pa.array(s), pa.array(e)], names=["doc_id", "nth", "first", "last"])


def lists(column: pa.Array):
    """The fields of each row's list of structs, as arrays; null counts as empty."""
    at = column.offsets.to_numpy()
    fields = [column.values.field(k).to_numpy(zero_copy_only=False) for k in range(column.type.value_type.num_fields)]
    null = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        lo, hi = (0, 0) if null[i] else (at[i], at[i + 1])
        yield tuple(f[lo:hi] for f in fields)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit big-endian words: sort by the first, then each group of equals by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(words[order[1:], 0] != words[order[:-1], 0])
    for k in range(1, words.shape[1]):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        sub = order[at]
        inner = np.lexsort((words[sub, k], group[at]))
        order[at] = sub[inner]
        step = np.zeros(len(order), bool)
        step[1:] = group[1:] != group[:-1]
        step[1:] |= words[order[1:], k] != words[order[:-1], k]
        group = np.cumsum(step)
    return order


def _shared(rows: list[tuple]):
    """Runs of windows that start earlier under the same head. rows: (head's number, k, left, doc_id, nth, at), whole heads only."""
    raw = np.frombuffer(b"".join(r[2] + r[1] for r in rows), np.uint8)
    head, left, doc, nth, at = (np.array(x, np.int64) for x in zip(*((r[0], len(r[2]), *r[3:]) for r in rows), strict=True))
    size = np.array([len(r[1]) + len(r[2]) for r in rows])
    count = size - WIDTH + 1
    which = np.repeat(np.arange(len(rows)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    win = np.zeros((len(which), 8 + WIDTH + 4), np.uint8)
    win[:, :4] = head[which].astype(">u4").view(np.uint8).reshape(-1, 4)
    win[:, 4] = left[which] - step  # distance to the anchor
    win[:, 8:8 + WIDTH] = raw[((np.cumsum(size) - size)[which] + step)[:, None] + np.arange(WIDTH)]
    words = win.view(">u8").astype(np.uint64)
    start = at[which] + step
    by = np.lexsort((start, nth[which], doc[which]))
    order = by[multikey_sort(words[by])]
    same = np.zeros(len(order), bool)
    same[1:] = (words[order[1:]] == words[order[:-1]]).all(1)
    gone = order[same]
    return _runs(doc[which[gone]], nth[which[gone]], start[gone], start[gone] + WIDTH)


def _compare(batches):
    """Rows of one partition, sorted by k and left -> removed runs. Across batches only the last row of each kind and
    the different suffixes of one head (at most HOT) are kept."""
    window, last, group, number, todo = None, None, [], 0, []
    for batch in batches:
        ks, lefts, docs, nths, ats, tos = (batch.column(i) for i in range(1, 7))
        doc, nth, at = (c.to_numpy(zero_copy_only=False) for c in (docs, nths, ats))
        run = ks.is_null().to_numpy(zero_copy_only=False)
        if run.any():
            yield _runs(doc[run], nth[run], at[run], tos.to_numpy(zero_copy_only=False)[run].astype(np.int64))
        hot = np.flatnonzero(~run & lefts.is_null().to_numpy(zero_copy_only=False))
        if len(hot):
            w = C.flat(ks.take(pa.array(hot)))[0].reshape(-1, WIDTH)
            same = np.zeros(len(w), bool)
            same[1:] = (w[1:] == w[:-1]).all(1)
            same[0] = window is not None and bool((w[0] == window).all())
            window = w[-1].copy()
            g = hot[same]
            yield _runs(doc[g], nth[g], at[g], at[g] + WIDTH)
        cold = np.flatnonzero(~run & ~lefts.is_null().to_numpy(zero_copy_only=False))
        some = pa.array(cold)
        gone = []
        for k, left, i in zip(ks.take(some).to_pylist(), lefts.take(some).to_pylist(), cold.tolist(), strict=True):
            if last is not None and last[1] == k and last[2] == left:
                gone.append((doc[i], nth[i], at[i], at[i] + len(k) + len(left)))
                continue
            if last is None or last[1][:GRAM] != k[:GRAM]:
                if len(group) > 1:
                    todo += group
                    if len(todo) >= SLICE:
                        yield _shared(todo)
                        todo = []
                number, group = number + 1, []
            last = (number, k, left, doc[i], nth[i], at[i])
            group.append(last)
        if gone:
            yield _runs(*(np.array(x, np.int64) for x in zip(*gone, strict=True)))
    if len(group) > 1:
        todo += group
    if todo:
        yield _shared(todo)


def _pack(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part, raw, offsets in C.chunks(batch):
            data = memoryview(np.ascontiguousarray(raw))
            arrays, names = [part.column(part.schema.get_field_index("doc_id")), pa.array([press.compress(data[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())], ["doc_id", "z"]
            if "along" in part.schema.names:
                arrays, names = [*arrays, part.column(part.schema.get_field_index("along"))], [*names, "along"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_bytes: bool):
    """Cut the runs out; column 4, if any, goes along as it is."""
    def run(batches):
        un = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i, (t, s, e) in enumerate(lists(batch.column(3))):
                doc, nth, z = (batch.column(k)[i].as_py() for k in range(3))
                text, spans, kept, last, gone = un.decompress(z), 0, [], 0, 0
                mine = t == nth
                if len(s) and mine.any():
                    s, e = merged([], s[mine], e[mine])
                    spans, gone = len(s), int((e - s).sum())
                    for a, b in zip(s.tolist(), e.tolist()):
                        kept.append(text[last:a])
                        last = b
                kept.append(text[last:])
                rest = b"".join(kept)
                rows.append((doc, len(text), gone, spans, hashlib.sha256(rest).hexdigest(), rest if with_bytes else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            arrays, names = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in CUT.split(", ")]
            if batch.num_columns > 4:
                arrays, names = [*arrays, batch.column(4)], [*names, "along"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = True, along: tuple[str, ...] = ()) -> DataFrame:
    """CUT for every row: sizes, removed bytes and maximal removed runs, digest of what is left, and those bytes.

    A null text is empty. Order is by doc_id, then start. Rows that repeat an id are documents of their own, ordered by
    a hash of their text, so of a row that is delivered twice one copy stays whole; rows with a null id are returned
    whole and remove nothing. Windows never cross documents. The columns named in `along` (narrow ones) come back as a
    struct of that name, so that nothing need be joined to the texts again.
    """
    spark = docs.sparkSession
    C.narrow_batches(spark)
    n = C.partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *([F.struct(*along).alias("along")] if along else []))
    more = f", along {texts.schema['along'].dataType.simpleString()}" if along else ""
    known = texts.select("doc_id", "text").where("doc_id is not null")
    splitters, frequent = sample(known, n)
    heads = known.mapInArrow(_heads(spark.sparkContext.broadcast(frequent)), "h long, doc_id long, m long")
    heads = heads.repartition(n, F.when(F.col("m") < _MARK, F.col("h")).otherwise(F.col("doc_id"))).sortWithinPartitions("h")
    asked = C.save(heads.mapInArrow(_repeated, HEAD), "heads")
    large = asked.where("doc_id is null").select("h", F.lit(True).alias("large"))
    asked = asked.where("doc_id is not null").join(C.small(large), "h", "left").select("doc_id", "h", (F.col("hot") | F.col("large").isNotNull()).alias("hot"))

    # both joins below read this one exchange
    packed = texts.mapInArrow(_pack, "doc_id long, z binary" + more).where("doc_id is not null").repartition(n, "doc_id")
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("z", *(["along"] if along else []))))
    packed = packed.withColumn("nth", nth)
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("h", "hot")).alias("asked"))
    rows = packed.join(asked, "doc_id").select("doc_id", "nth", "z", "asked").mapInArrow(_suffixes(spark.sparkContext.broadcast(splitters), n), SUFFIX)
    runs = rows.repartitionById(n, "part").sortWithinPartitions("k", "left", "doc_id", "nth", "at").mapInArrow(_compare, RUN)
    gone = runs.groupBy("doc_id").agg(F.collect_list(F.struct("nth", "first", "last")).alias("runs"))
    whole = texts.where("doc_id is null").mapInArrow(_pack, "doc_id long, z binary" + more).withColumns({"nth": F.lit(0), "runs": F.lit(None).cast("array<struct<nth: int, first: long, last: long>>")})
    columns = ["doc_id", "nth", "z", "runs", *(["along"] if along else [])]
    return packed.join(gone, "doc_id", "left").select(*columns).unionByName(whole.select(*columns)).mapInArrow(_cut(with_bytes), CUT + more)
