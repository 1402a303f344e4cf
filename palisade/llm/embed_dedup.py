"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Equal vectors are folded into one row with a count first. Centroids are fitted on a bounded sample; every vector is
then written to its nearest cells, the more the more cells there are, so a pair on two sides of a border still meets; it
counts in the smallest cell that both are written to. A cell of more than BLOCK rows is split into blocks and every pair of blocks is one small task, so a hot cell is spread out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

BLOCK, PROBES = 1024, 3
#: Vectors that occur twice up to which they are broadcast (8 bytes a component).
COPIES = 20_000


def probes(cells: int) -> int:
    """Cells a vector is written to: PROBES up to 16 cells, one more for every fourfold number."""
    return PROBES + max(0, int(np.ceil(np.log2(max(cells, 1) / 16) / 2)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell keeps its old centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def fit_cells(vectors: DataFrame, rows: int, sample_rows: int = 16384, per_cell: int = 256, most_cells: int = 8192) -> dict[int, np.ndarray]:
    """Centroids for each vector length: one for every per_cell rows, at most most_cells, from about sample_rows rows, or
    eight a cell if that is more, chosen by a hash of the id and packed as floats. That many reach the driver."""
    sample_rows = max(sample_rows, 8 * min(rows // per_cell, most_cells))
    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [np.asarray(v, np.float32).tobytes() for v in pdf["v"]]})

    got = vectors.where(C.by_hash(F.col("id"), C.share(vectors.sparkSession, rows, sample_rows))).select("v").mapInPandas(pack, "x binary").collect()
    out: dict[int, list] = {}
    for r in got:
        out.setdefault(len(r["x"]) // 4, []).append(np.frombuffer(r["x"], np.float32))
    cells = {}
    for d, vs in out.items():
        x = np.asarray(vs, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cells[d] = spherical_kmeans(x, int(np.clip(rows * len(vs) / max(1, len(got)) / per_cell, 1, most_cells)))
    return cells


def _places(cells):
    """Rows with the places (cells) they are written to; a length that the sample lacks has one cell."""
    def run(batches):
        for pdf in batches:
            near = [[0]] * len(pdf)
            sizes = pdf["v"].map(len).to_numpy()
            for d in np.unique(sizes):
                c, rows = cells.value.get(int(d)), np.flatnonzero(sizes == d)
                if c is None:
                    continue
                for at in range(0, len(rows), 512):
                    part = rows[at:at + 512]
                    s = np.stack(pdf["v"].iloc[part].to_numpy()).astype(float) @ c.T
                    top = np.argsort(-s, axis=1, kind="stable")[:, :probes(len(c))]
                    for r, places in zip(part, top.tolist(), strict=True):
                        near[r] = places
            yield pdf.assign(near=near)
    return run


def _compare(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, cell, i, j = key
        ids, many = pdf["id"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = np.full((len(ids), pdf["near"].map(len).max()), -1)
        for r, places in enumerate(pdf["near"]):
            near[r, : len(places)] = places
        block = pdf["block"].to_numpy()
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        link = x[left] @ x[right].T >= threshold
        a, b = np.nonzero(link & (ids[left][:, None] != ids[right][None, :]))
        a, b = left[a], right[b]
        # a pair that meets in several cells counts only in the smallest that both are written to
        fair = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 17):
            p, q = near[a[at:at + (1 << 17)]], near[b[at:at + (1 << 17)]]
            first = np.full(len(p), np.iinfo(p.dtype).max)
            for c in p.T:
                both = (c >= 0) & (q == c[:, None]).any(1)
                first[both] = np.minimum(first, c)[both]
            fair[at:at + (1 << 17)] = first == cell
        a, b = a[fair], b[fair]
        if i == j:
            links = np.bincount(a, many[b], minlength=len(ids))
        else:
            links = np.bincount(a, many[b], minlength=len(ids)) + np.bincount(b, many[a], minlength=len(ids))
        low = ids.copy()
        while len(a):  # smallest id of each local group: a spanning star instead of all pairs
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            if (new == low).all():
                break
            low = new
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "low": low[some]})
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, per_cell: int = 256, most_cells: int = 8192, sample_rows: int = 16384) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing; vectors of
    different lengths never link. Components may have any finite magnitude. Rows that repeat an id count as one more equal vector. Cells grow in number with the
    rows up to most_cells (2 million rows at the defaults); beyond, raise it (centroids are 8 bytes a component, sent to
    every executor), or cells grow in size and pairs with their square.
    """
    C.narrow_batches(vectors.sparkSession)
    v = F.col(vector_col)
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"  # kept so: half the bytes, products are double
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0).cast("float") if single else x.cast("double") + F.lit(0.0)).alias("v"))
    kind = "float" if single else "double"
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.withColumn("good", good)
    if not single:  # squares of very large or small components would be infinite or zero
        most = F.array_max(F.transform("v", lambda x: F.abs(x)))
        rows = rows.withColumn("v", F.when(F.col("good") & ~most.between(1e-20, 1e20), F.transform("v", lambda x: x / most)).otherwise(F.col("v")))
    rows = C.save(rows, "vectors")
    folded = C.save(rows.where("good").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("m")), "folded")
    n = folded.count()
    if n == 0:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    spark = vectors.sparkSession
    cells = spark.sparkContext.broadcast(fit_cells(folded, n, sample_rows, per_cell, most_cells))  # at most most_cells centroids
    placed = folded.mapInPandas(_places(cells), f"v array<{kind}>, id long, m long, near array<int>")
    placed = placed.withColumn("len", F.size("v")).withColumn("cell", F.explode("near"))
    placed = C.save(placed, "cells")
    sizes = placed.groupBy("len", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(sizes), ["len", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("_o", other).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")})
    found = C.save(spread.select("len", "cell", "i", "j", "id", "m", "v", "near", "block").groupBy("len", "cell", "i", "j").applyInPandas(_compare(threshold), "id long, links long, low long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component_id", "comp")
    # only vectors that occur twice are joined back to their copies, and only rows with a link to what was found
    copies = C.small(C.save(folded.where("m > 1").select("v", F.col("id").alias("rep"), "m"), "copies"), COPIES)
    named = rows.where("good").join(copies, "v", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("m", F.lit(1)).alias("m"))
    of = links.withColumnRenamed("id", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    joined = named.join(C.small(C.save(of, "linked")), "rep", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    rest = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
