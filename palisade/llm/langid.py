"""Language identification: averaged hashed subword embeddings with a linear softmax.

Each text is the mean of the embeddings of its hashed byte 3- and 4-grams; a linear softmax on that mean
gives the language. Both are trained together by stochastic gradient descent in numpy on a bounded sample;
a temperature fitted on rows kept out of the descent calibrates the probabilities. Text of no learned language, or of
letters at random, has a probability far below theirs: it is rejected where its log-odds are under half of what nearly
all of those rows reach.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS, DIM, SIZES = 14, 16, (3, 4)
#: Bytes other than ASCII letters and parts of non-ASCII characters count as a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # bucket x language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(raw: np.ndarray, offsets: np.ndarray):
    """For each size: bucket of every n-gram that lies inside one text and has a letter, and counts by text."""
    b = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in SIZES:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n, np.uint32)
        letter = np.zeros(m, bool)
        for k in range(n):
            part = b[k:k + m]
            h = h * np.uint32(0x01000193) + part * np.uint32(0x85EBCA6B)
            letter |= part != 32
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        inside = letter & (row[:m] == row[n - 1:])
        yield (h[inside] >> np.uint32(32 - BITS)), np.bincount(row[:m][inside], minlength=len(offsets) - 1)


def _features(batches):
    """Per row: distinct buckets and their shares (at most 2^BITS of them, however long the text)."""
    for batch in batches:
        for part, raw, offsets in C.chunks(batch):
            n = part.num_rows
            keys, counts = [], []
            for h, per in _grams(raw, offsets):
                keys.append((np.repeat(np.arange(n), per).astype(np.int64) << BITS) | h)
            if keys:
                keys, counts = np.unique(np.concatenate(keys), return_counts=True)
            rows = np.asarray(keys, np.int64) >> BITS
            at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("lang")),
                C.packed((np.asarray(keys, np.int64) & ((1 << BITS) - 1)).astype(np.uint16), at),
                C.packed(np.asarray(counts, np.int32), at),
            ], names=["lang", "buckets", "counts"])


def train(docs: DataFrame, sample_rows: int = 4000, steps: int = 600, seed: int = 1, rejected: float = 0.005, most_languages: int = 1000) -> LanguageModel | None:
    """Learn from rows with a text and a language. None if there are none.

    sample_rows bounds the rows that are learned from, in one task (about sample_rows / languages of each language, chosen by
    a hash of doc_id); each carries at most 2^14 buckets, so that task's share is bounded too. `rejected` is the
    share of good texts whose log-odds may lie below the value of which half is the threshold. Rows that repeat an id
    all count. Only the most_languages most frequent labels are learned, which bounds the model for a dirty column.
    """
    C.narrow_batches(docs.sparkSession)
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    counts = {r["lang"]: r["count"] for r in counts.collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    parts = F.coalesce(*[F.when(F.col("lang") == k, F.lit(C.share(docs.sparkSession, n, each))) for k, n in counts.items()])
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < parts * (1 << 30))
    features = C.with_text_only(chosen, "doc_id", "lang").mapInArrow(_features, "lang string, buckets binary, counts binary").where("length(buckets) > 0")
    languages = tuple(sorted(counts))

    def fit(batches):
        """One task fits the model to the sample, so that the driver sees nothing but the model."""
        got = [r for batch in batches for r in batch.to_pylist()]
        if got:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(_fit(got, languages, steps, seed, rejected))]})

    fitted = features.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def _fit(got: list[dict], languages: tuple[str, ...], steps: int, seed: int, rejected: float) -> LanguageModel:
    """Stochastic gradient descent over the sampled rows (lang, buckets, counts), then temperature and threshold."""
    got.sort(key=lambda r: (r["lang"], r["buckets"], r["counts"]))  # the same model however the rows were partitioned
    code = {k: i for i, k in enumerate(languages)}
    y = np.array([code[r["lang"]] for r in got])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    kept, fit = (order[: len(y) // 5], order[len(y) // 5:]) if len(y) >= 50 else (order, order)
    sparse = []
    for r in got:
        c = np.frombuffer(r["counts"], np.int32)
        sparse.append((np.frombuffer(r["buckets"], np.uint16), (c / c.sum()).astype(np.float32)))
    got.clear()

    def dense(rows):
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for i, r in enumerate(rows):
            x[i, sparse[r][0]] = sparse[r][1]
        return x

    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    squares = [np.full_like(v, 1e-8) for v in (emb, soft, bias)]  # per-coordinate learning rates
    at, order = 0, fit
    for step in range(steps):
        if at + 64 > len(order) or step == 0:
            at, order = 0, rng.permutation(fit)
        rows = order[at:at + 64]
        at += 64
        x = dense(rows)
        hidden = x @ emb
        z = hidden @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p /= len(rows)
        for v, q, grad in zip((emb, soft, bias), squares, (x.T @ (p @ soft.T), hidden.T @ p, p.sum(0)), strict=True):
            q += grad * grad
            v -= 0.3 * (1 - step / steps) * grad / np.sqrt(q)
    weights = emb @ soft
    z = np.concatenate([dense(kept[i:i + 64]) @ weights + bias for i in range(0, len(kept), 64)])
    loss = []
    temperatures = np.geomspace(0.2, 8, 40)
    for t in temperatures:
        s = z / t
        s = s - s.max(1, keepdims=True)
        loss.append(float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(kept)), y[kept]])))
    t = float(temperatures[int(np.argmin(loss))])
    s = np.sort(z.astype(float) / t, axis=1)
    others = np.exp(s[:, :-1] - s[:, -1:]).sum(1)  # odds against the best language
    low = float(np.quantile(-np.log(np.maximum(others, 1e-300)), rejected))
    return LanguageModel(languages, weights.astype(np.float32), bias, t, float(1 / (1 + np.exp(-low / 2))))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of docs plus lang_pred and score.

    A null text or one without any letter gets `und` and score 0; so does every row if there is no model.
    Ties between languages go to the first in alphabetical order.
    """
    C.narrow_batches(docs.sparkSession)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^14 x languages floats

    @F.pandas_udf("lang string, score double")
    def classify(texts):
        import pandas as pd

        m = sent.value
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary())], names=["text"])
        best, score = [], []
        for _, raw, offsets in C.chunks(batch):
            n = len(offsets) - 1
            z, total = np.zeros((n, len(m.languages))), np.zeros(n)
            for h, per in _grams(raw, offsets):
                total += per
                for k in range(len(m.languages)):
                    z[:, k] += C.sums(m.table[h, k], per)
            z = (z / np.maximum(total, 1)[:, None] + m.bias) / m.temperature
            best.append(z.argmax(1))
            score.append(1 / np.exp(z - z.max(1, keepdims=True)).sum(1))
        names = np.array(m.languages, object)
        return pd.DataFrame({"lang": names[np.concatenate(best)] if best else [], "score": np.concatenate(score) if score else []})

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    p = C.fresh(docs, "p")
    out = docs.withColumn(p, classify(F.col("text").cast("binary")))
    return out.withColumns({
        "lang_pred": F.when(has_letter, F.col(f"{p}.lang")).otherwise("und"),
        "score": F.when(has_letter, F.col(f"{p}.score")).otherwise(0.0),
    }).drop(p)


def rejected(model: LanguageModel | None) -> Column:
    """True for rows of predict() whose language is unknown or whose calibrated score is below the threshold."""
    return F.lit(False) if model is None else (F.col("lang_pred") == "und") | (F.col("score") < model.threshold)
