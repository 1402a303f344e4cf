"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The learner keeps a learning rate for each coordinate and sets most weights to exactly zero (L1), so what is
sent to the executors is the few buckets with a weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 20
_ENDS = np.ones(256, bool)
_ENDS[48:58] = _ENDS[65:91] = _ENDS[97:123] = _ENDS[128:] = False
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray  # those with a weight, sorted
    values: np.ndarray
    bias: float

    @cached_property
    def weights(self) -> np.ndarray:
        """All buckets; made where it is needed, never sent."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.values
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "weights"}


def _buckets(raw: np.ndarray, offsets: np.ndarray):
    """Rows and buckets of unigrams, bigrams and skip-grams (one word between), with repeats."""
    raw = C.LOWER[raw]
    starts, stops, before = C.word_spans(raw, offsets, _ENDS)
    w = C.word_hashes(raw, starts, stops)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    shift = np.uint64(64 - BITS)
    yield row, (C.mix(w) >> shift).astype(np.int64)
    for gap, salt in ((1, _B), (2, _S)):
        if len(w) > gap:
            same = row[:-gap] == row[gap:]
            yield row[:-gap][same], (C.mix(w[:-gap] * _A + w[gap:] * salt)[same] >> shift).astype(np.int64)


def _features(batches):
    for batch in batches:
        for part, raw, offsets in C.chunks(batch):
            n = part.num_rows
            keys = np.unique(np.concatenate([(r.astype(np.int64) << BITS) | h for r, h in _buckets(raw, offsets)]))
            at = np.concatenate([[0], np.cumsum(np.bincount(keys >> BITS, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("place")),
                part.column(part.schema.get_field_index("label")),
                C.packed((keys & ((1 << BITS) - 1)).astype(np.int32), at),
            ], names=["place", "label", "buckets"])


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, alpha=3.0, beta=1.0, l1=5.0, l2=0.01, epochs=12, least=3, seed=1, steps=40_000) -> ToxicityModel:
    """FTRL-proximal with binary features; the bias is not penalised. Buckets of fewer than `least` rows are left out.

    The rows are passed over `epochs` times, and as often as it takes for `steps` of them, so that weights settle on
    few rows too."""
    epochs = max(epochs, -(-steps // max(1, len(rows))))
    seen = np.zeros(1 << BITS, np.int32)
    for x in rows:
        seen[x] += 1
    rows = [x[seen[x] >= least] for x in rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = bias = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            bias = -bz / ((beta + np.sqrt(bn)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y[i]
            root = np.sqrt(nx + g * g)
            z[x] += g - (root - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            rb = np.sqrt(bn + g * g)
            bz += g - (rb - np.sqrt(bn)) / alpha * bias
            bn += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    some = np.flatnonzero(w)
    return ToxicityModel(some.astype(np.int32), w[some].astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, **options) -> ToxicityModel:
    """Learn from `labels` (doc_id, label 0/1). About sample_rows of them, chosen by a hash of doc_id, are used;
    so many ids are broadcast and so many rows reach the driver, where they are put in the order of another hash of
    the id (then of label and features): the model does not depend on how the rows were partitioned. Rows that repeat
    an id all count. Without any row the model scores 0.5."""
    C.narrow_batches(docs.sparkSession)
    labels = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = labels.where(C.by_hash(F.col("doc_id"), C.share(docs.sparkSession, labels.count(), sample_rows)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("place", F.xxhash64("doc_id", F.lit("order")))
    got = C.with_text_only(rows, "place", "label").mapInArrow(_features, "place long, label int, buckets binary").collect()
    if not got:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    got.sort(key=lambda r: (r["place"], r["label"], bytes(r["buckets"])))
    return fit_ftrl([np.frombuffer(r["buckets"], np.int32) for r in got], np.array([float(r["label"]) for r in got]), **options)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of docs plus score. Each distinct n-gram of the whole text counts once; null or empty: the bias alone."""
    C.narrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights, most of them zero and left out

    @F.pandas_udf("double")
    def toxicity(texts):
        import pandas as pd

        m, out = sent.value, []
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary())], names=["text"])
        for part, raw, offsets in C.chunks(batch):
            keys = []
            for r, h in _buckets(raw, offsets):
                hit = m.weights[h] != 0
                keys.append((r[hit].astype(np.int64) << BITS) | h[hit])
            keys = np.unique(np.concatenate(keys))
            out.append(np.bincount(keys >> BITS, m.weights[keys & ((1 << BITS) - 1)], minlength=part.num_rows))
        z = np.concatenate(out) + m.bias if out else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return docs.withColumn("score", toxicity(F.col("text").cast("binary")))
