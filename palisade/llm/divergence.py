"""Source divergence audit: how far each source's use of terms is from the other sources of its language.

Terms are counted by document in tasks and summed by (language, term, source). A language's kept terms get dense ids,
frequent ones first, so that rare terms with equal counts lie together. Ids are cut into segments; a task builds, over one
segment, a tree of counts for each source with nodes hash-consed: subtrees of equal counts are one node, whichever source
or place they come from. The trees of two sources are walked together from the roots down; a pair of nodes that was met
before is not walked again but counted, so every pair of equal nodes is priced once. Prices add up over segments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Bytes that are part of a term, with A-Z lower-cased; all others become blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, bytes of text for each pass over its terms, and terms that a task holds.
SLICE, PASS, HELD = 1 << 20, 4 << 20, 400_000
#: Terms of a segment, and count cells (terms x sources) that one may have.
SEGMENT, CELLS = 1 << 14, 1 << 21
UNIT = 1_000_000_000
COUNTS = "lang string, term string, source string, n long, docs long"
PRICED = "part string, source string, item string, value long"


def _slices(b: bytes) -> Iterator[bytes]:
    """Pieces of a translated text that end at a blank."""
    at = 0
    while at < len(b):
        to = b.find(b" ", min(at + SLICE, len(b) - 1))
        to = len(b) if to < 0 else to
        yield b[at:to]
        at = to + 1


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS rows of documents (lang, source, text), summed over up to HELD terms of a task."""
    total: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush():
        for (lang, source), (n, docs) in total.items():
            k = len(n)
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            counts = [pa.array(np.fromiter(values, np.int64, k)) for values in (n.values(), map(docs.__getitem__, n))]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), terms, pa.repeat(source, k), *counts], ["lang", "term", "source", "n", "docs"])
        total.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source", "text")), strict=True):
            b = text.as_buffer().to_pybytes().translate(_TERMS) if text.is_valid else b""
            passes = 1 + len(b) // PASS
            for p in range(passes):  # a long text: a share of its terms, chosen by their hash, at a time
                n, docs = total.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                seen: set[bytes] = set()
                for piece in _slices(b):
                    words = piece.split() if passes == 1 else [t for t in piece.split() if hash(t) % passes == p]
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n)
                if held >= HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def _numbered(terms: DataFrame) -> DataFrame:
    """terms plus `id`: from 0 within each lang, by falling total, then term. Nothing is ordered in one task."""
    order = [F.col("lang"), F.col("total").desc(), F.col("term")]
    d = C.save(terms.repartitionByRange(C.partitions(terms.sparkSession), *order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = d.groupBy("lang", "_p").count()  # a row for each language and partition
    sizes = sizes.select("lang", "_p", (F.sum("count").over(W.partitionBy("lang").orderBy("_p")) - F.col("count")).alias("_before"))
    inner = F.row_number().over(W.partitionBy("_p", "lang").orderBy(F.col("total").desc(), "term"))
    return d.join(C.small(C.save(sizes, "sizes")), ["lang", "_p"]).withColumn("id", F.col("_before") + inner - 1).drop("_p", "_before")


class Trees:
    """Hash-consed segment trees over rows of counts (one row a source, as many columns as terms).

    Level 0 holds the distinct counts; a node of level k + 1 is a distinct pair of nodes of level k. `roots` has the root
    of each row, `left` and `right` the children of each node by level. The last column may be filled up with -1: no term.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        full = np.full((len(counts), width), -1, np.int64)
        full[:, : counts.shape[1]] = counts
        self.values, at = np.unique(full, return_inverse=True)
        at = at.reshape(full.shape)
        self.left, self.right = [], []
        while at.shape[1] > 1:
            pairs, new = np.unique(at[:, ::2] * np.int64(at.max() + 1) + at[:, 1::2], return_inverse=True)
            self.left.append(pairs // (at.max() + 1))
            self.right.append(pairs % (at.max() + 1))
            at = new.reshape(len(at), -1)
        self.roots = at[:, 0]

    def nodes(self) -> int:
        return len(self.values) + sum(map(len, self.left))

    def meet(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts of row i, counts of row j, terms that have them): every pair of nodes of the two trees is walked once,
        with the number of places where it stands."""
        a, b, times = self.roots[i:i + 1], self.roots[j:j + 1], np.ones(1, np.int64)
        for k in reversed(range(len(self.left))):
            size = np.int64(len(self.left[k - 1]) if k else len(self.values))
            left, right = self.left[k], self.right[k]
            codes, place = np.unique(np.concatenate([left[a] * size + left[b], right[a] * size + right[b]]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, times]), len(codes)).astype(np.int64)
            a, b = codes // size, codes % size
        x, y = self.values[a], self.values[b]
        real = x >= 0
        return x[real], y[real], times[real]


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of counts of a group with `total` occurrences of `terms` kept terms: exact, by Python's numbers if need be."""
    if len(counts) and int(counts.max()) >= (1 << 62) // UNIT:
        counts = counts.astype(object)
    return (1 + UNIT * (counts + 1) // (total + terms)).astype(np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _segment(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """PRICED rows of one segment: pairs of sources, and the terms of greatest value of each source.

        Rows without a term name the language's groups: its sources with their totals, and itself (a null source)."""
        named = pdf["term"].isna()
        groups = pdf[named]
        groups = groups[~groups["source"].isna()].sort_values("source")
        sources, totals = groups["source"].tolist(), [int(n) for n in groups["n"]]
        v, whole = (int(x) for x in pdf[named & pdf["source"].isna()][["id", "n"]].iloc[0])
        rows = pdf[~named]
        own = rows[rows["source"].isna()].sort_values("id")
        terms, ids = own["term"].tolist(), own["id"].to_numpy(np.int64)
        rest = rows[~rows["source"].isna()]
        counts = np.zeros((len(sources) + 1, len(ids)), np.int64)
        counts[-1] = own["n"].to_numpy(np.int64)
        at = np.searchsorted(ids, rest["id"].to_numpy(np.int64))
        counts[pd.Index(sources).get_indexer(rest["source"]) if len(rest) else [], at] = rest["n"].to_numpy(np.int64)
        out: list[tuple] = []
        if not len(ids):
            return pd.DataFrame([("pair", a, b, 0) for a in sources for b in sources if a != b], columns=["part", "source", "item", "value"])
        trees = Trees(counts)
        for i, a in enumerate(sources):
            for j in range(i + 1, len(sources)):
                x, y, times = trees.meet(i, j)
                p, q = shares(x, totals[i], v), shares(y, totals[j], v)
                out += [("pair", a, sources[j], int((price(p, q) * times).sum())), ("pair", sources[j], a, int((price(q, p) * times).sum()))]
            # against the language: every pair of counts is priced once, terms get the price of theirs
            x, y, _ = trees.meet(i, len(sources))
            p, q = shares(x, totals[i], v), shares(y, whole, v)
            keep = (x > 0) & (p > q)
            known = dict(zip(zip(x[keep].tolist(), y[keep].tolist()), price(p, q)[keep].tolist()))
            mine = np.flatnonzero(counts[i] > 0)
            found = [(-known[c], terms[t]) for t, c in zip(mine.tolist(), zip(counts[i][mine].tolist(), counts[-1][mine].tolist())) if c in known]
            out += [("term", a, term, -f) for f, term in sorted(found)[:most]]
        return pd.DataFrame(out, columns=["part", "source", "item", "value"]).astype({"value": "int64"})

    def keyed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf).assign(lang=key[0])[["lang", "part", "source", "item", "value"]]

    return keyed


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text; other columns are not used).

    A term is a run of ASCII letters, lower-cased, and characters beyond ASCII; a language keeps those in at least
    least_docs of its rows. A null lang, source or text is ''. With N occurrences of the V kept terms in a group, a term with
    n has p = 1 + floor(10^9 (n + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q). Part `pair`: every other source of the
    language, by the sum of f over all kept terms (0 without any), q the other's p. Part `term`: the most_terms kept terms
    that the source has with p above the language's, by f. Ranks run from 1 by value, greatest first, then by item.
    No documents give no rows. Values are below 2^63 as long as V is below 10^9.
    """
    spark = docs.sparkSession
    C.narrow_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text("lang").alias("lang"), text("source").alias("source"), "text")
    groups = C.save(d.groupBy("lang", "source").count(), "groups")
    partial = d.mapInArrow(_count, COUNTS).repartition("lang", "term")  # one exchange for the three groupings below
    by = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= least_docs)
    terms = C.save(terms.drop("docs"), "kept")  # read twice: once to find the borders of the ranges
    terms = C.save(_numbered(terms), "terms")
    # totals of groups and languages, terms of a language; every group that occurs, also without terms
    sums = terms.select("lang", F.explode("by").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    groups = groups.select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["n"])
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).join(terms.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    width = F.least(F.lit(SEGMENT), F.greatest(F.lit(CELLS) / (F.col("sources") + 1), F.lit(64))).cast("long")
    langs = C.save(langs.withColumn("width", width), "langs")
    last = F.floor((F.greatest("v", F.lit(1)) - 1) / F.col("width"))
    named = langs.select("lang", F.col("v").alias("id"), F.col("n").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    columns = ("lang", "segment", "id", "term", "source", "n")
    none = F.lit(None).cast("string")
    rows = terms.join(C.small(langs.select("lang", "width")), "lang").withColumn("segment", F.floor(F.col("id") / F.col("width")))
    rows = rows.withColumn("by", F.concat("by", F.array(F.struct(none.alias("source"), F.col("total").alias("n"))))).select("lang", "segment", "id", "term", F.explode("by").alias("b")).select("lang", "segment", "id", F.when(F.col("b.source").isNull(), F.col("term")).otherwise("").alias("term"), "b.source", "b.n")
    rows = rows.unionByName(named.withColumns({"term": none, "source": none, "n": F.col("whole")}).select(*columns))
    rows = rows.unionByName(named.join(groups, "lang").withColumn("term", none).select(*columns))
    priced = C.save(rows.groupBy("lang", "segment").applyInPandas(_segment(most_terms), f"lang string, {PRICED}"), "priced")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    top = priced.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(top.select(*pairs.columns)).select("lang", "source", "part", "item", "value", "rank")
