"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node is a rule
(a conjunction of comparisons). A logistic regression with an L1 penalty keeps few of them, and those are
compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The statistics, in the order in which they are computed.
STATS = ("n_words", "word_len", "upper", "digit", "exclaim", "pipe", "symbol", "punct", "nonascii", "distinct_words",
         "top_word", "n_lines", "line_words", "distinct_lines", "ended_lines", "title_words", "marked_words")
_ENDS_LINE = np.zeros(256, bool)
_ENDS_LINE[10] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SYMBOL = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#$%&*+/<=>@\\^_`{}~[]")
_LETTER, _PUNCT, _STOP = _class(bytes(range(65, 91)) + bytes(range(97, 123))) | (np.arange(256) >= 128), _class(b".,;:?'\"()-"), _class(b".!?")


def _runs(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: number of distinct hashes, and how often the most frequent occurs."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, row[at], np.diff(np.append(at, len(h))))
    return np.bincount(row[at], minlength=n), most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x STATS. Shares are of bytes, words or lines; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    count = lambda member: np.bincount(row[member[raw]], minlength=n)
    starts, stops, before = C.word_spans(raw, offsets)
    words = np.diff(before)
    some = np.maximum(words, 1)
    of = np.repeat(np.arange(n), words)
    distinct, top = _runs(of, C.word_hashes(raw, starts, stops), n)
    ls, le, lb = C.word_spans(raw, offsets, _ENDS_LINE)
    lines = np.diff(lb)
    lof = np.repeat(np.arange(n), lines)
    dl, _ = _runs(lof, C.word_hashes(raw, ls, le), n)
    some_lines = np.maximum(lines, 1)
    letters = np.maximum(count(_LETTER), 1)
    per = lambda mask, of, total: np.bincount(of[mask], minlength=n) / total
    lastb = raw[stops - 1] if len(stops) else raw[:0]
    cols = [words, (np.bincount(of, stops - starts, minlength=n)) / some, count(_UPPER) / letters, count(_DIGIT) / size,
            count(_class(b"!")) / size, count(_class(b"|")) / size, count(_SYMBOL) / size, count(_PUNCT) / size,
            count(np.arange(256) >= 128) / size, distinct / some, top / some, lines, words / some_lines, dl / some_lines,
            per(_STOP[raw[le - 1]] if len(le) else np.zeros(0, bool), lof, some_lines),
            per(_UPPER[raw[starts]] if len(starts) else np.zeros(0, bool), of, some),
            per(~_LETTER[lastb] & ~_PUNCT[lastb], of, some)]
    return np.column_stack([np.asarray(c, np.float64) for c in cols])


def add_statistics(docs: DataFrame, name: str = "stats") -> DataFrame:
    """docs plus a struct column of doubles, called `name`."""
    C.narrow_batches(docs.sparkSession)
    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def stats(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary())], names=["text"])
        parts = [statistics(raw, offsets) for _, raw, offsets in C.chunks(batch)]
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(STATS))), columns=list(STATS))

    return docs.withColumn(name, stats(F.col("text").cast("binary")))


# --- rules -------------------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2, least: int = 10) -> list[Rule]:
    """Paths of trees that are boosted on the logistic loss; thresholds are quantiles of the sample."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]  # code > i  <=>  x > cuts[i]
    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        todo = [(np.arange(len(y)), (), 0)]
        while todo:
            rows, path, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if level < depth and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    code = coded[j][rows]
                    gl, hl, nl = (np.cumsum(np.bincount(code, v, minlength=len(c) + 1))[:-1] for v in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[1] is None:
                f[rows] += rate * gs / (hs + 1)
                continue
            j, i = best[1:]
            above = coded[j][rows] > i
            for side in (False, True):
                step = (j, side, float(cuts[j][i]))
                to = tuple(sorted((*path, step)))
                rules.setdefault(to)
                todo.append((rows[above == side], to, level + 1))
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def fit_lasso(r: np.ndarray, y: np.ndarray, penalty: float = 0.0005, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    n, k = r.shape
    a = np.column_stack([r, np.ones(n, np.float32)])
    v = np.random.default_rng(0).normal(size=k + 1).astype(np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(np.linalg.norm(a.T @ (a @ v))) / n + 1e-9)
    w = np.zeros(k + 1, np.float32)
    look, t = w.copy(), 1.0
    for _ in range(steps):
        z = a @ look
        new = look - rate * (a.T @ ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y).astype(np.float32)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = (new + (t - 1) / t1 * (new - w)).astype(np.float32), new.astype(np.float32), t1
    return w[:k].astype(float), float(w[k])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12000) -> RuleModel:
    """Learn from `labels` (doc_id, label 0/1). About sample_rows rows, chosen by a hash of doc_id, reach the driver
    as statistics (17 doubles each), sorted by them. Rows that repeat an id all count. Without rows, or with one class
    only, the model is a constant."""
    labels = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = labels.where(C.by_hash(F.col("doc_id"), C.share(docs.sparkSession, labels.count(), sample_rows)))
    got = add_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("label", "stats.*").toPandas()
    got = got.sort_values(["label", *STATS])  # the same model however the rows were partitioned
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return RuleModel((), (), float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -9, 9)))
    x = got[list(STATS)].to_numpy()
    rules = grow_rules(x, y)
    hold = np.column_stack([holds(r, x) for r in rules]).astype(np.float32)
    _, first = np.unique(hold, axis=1, return_index=True)
    rules, hold = [rules[i] for i in sorted(first)], hold[:, sorted(first)]
    w, bias = fit_lasso(hold, y)
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-4]
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), bias)


def compile_rules(model: RuleModel, name: str = "stats") -> Column:
    """The model as one column expression over the struct `name`."""
    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        test = F.lit(True)
        for j, above, t in rule:
            stat = F.col(f"{name}.{STATS[j]}")
            test = test & ((stat > F.lit(t)) if above else (stat <= F.lit(t)))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """All columns of docs plus score (which replaces one of that name); a null text counts as empty, and rows with
    the same text have the same score."""
    name = C.fresh(docs, "stats")
    return add_statistics(docs, name).withColumn("score", compile_rules(model, name)).drop(name)
