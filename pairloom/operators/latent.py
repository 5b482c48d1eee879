"""Latent vectors: neighbours, centroids, retrieval, mixtures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _vectors(t: pa.Table) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in t["embedding"].to_pylist()]) if t.num_rows else np.zeros((0, 1))


def _vector_nearest(k: int):
    def each(t: pa.Table) -> pa.Table:
        order = np.argsort(t["cell"].to_numpy(), kind="stable")
        cell, x = t["cell"].to_numpy()[order], _vectors(t)[order]
        a, b, d, r = [], [], [], []
        n = min(k, len(cell) - 1)
        for at in range(0, len(cell), 256):
            diff = x[at : at + 256, None, :] - x[None, :, :] if len(cell) <= 512 else None
            if diff is not None:
                dist = np.sqrt((diff * diff).sum(-1))
            else:
                own = x[at : at + 256]
                dist = np.sqrt(np.maximum((own * own).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * own @ x.T, 0))
            dist[np.arange(len(dist)), at + np.arange(len(dist))] = np.inf
            pick = np.argsort(dist, axis=1, kind="stable")[:, :n]
            a.append(np.repeat(cell[at : at + 256], n))
            b.append(cell[pick].ravel())
            d.append(np.take_along_axis(dist, pick, 1).ravel())
            r.append(np.tile(np.arange(1, n + 1), len(dist)))
        cat = [np.concatenate(v) if v else np.zeros(0) for v in (a, b, d, r)]
        return pa.table({"a": pa.array(cat[0].astype(np.int64)), "b": pa.array(cat[1].astype(np.int64)), "distance": pa.array(cat[2], pa.float64()), "rank": pa.array(cat[3].astype(np.int32))})

    return each


def vector_knn(vectors: DataFrame, k: int) -> DataFrame:
    """Directed: a, b, distance, rank of each vector's k nearest in its section (cell, embedding, section)."""
    return vectors.groupBy("section").applyInArrow(_vector_nearest(k), "a long, b long, distance double, rank int")


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """label, centroid: the mean vector of each label."""
    flat = vectors.select(F.col(label).alias("label"), F.posexplode("embedding").alias("at", "x"))
    mean = flat.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """cell, label, cosine: the centroid of largest cosine, ties to the least label; a vector with nulls, or of another width, has a null cosine.

    The centres are one row per community and are compared with every vector: they are collected
    into one matrix, so the vectors are scanned once and nothing is shuffled.
    """
    from ..functions.expr import unit_row

    rows = [(r["label"], [float(v) for v in r["c"]]) for r in centers.select("label", unit_row(F.col("centroid")).alias("c")).orderBy("label").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 centroids")
    labels, table = np.array([k for k, _ in rows], np.int64), np.array([c for _, c in rows], np.float64).reshape(len(rows), -1)
    wide = "long" if len(rows) and np.abs(labels).max() > 2**31 - 1 else "int"
    schema = T.StructType([vectors.select("cell").schema[0], *T._parse_datatype_string(f"label {wide}, cosine double").fields])
    block = max(1, (1 << 20) // max(len(rows), 1))

    def each(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                given, n = b.column("e"), table.shape[1]
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(given), -1))
                full = np.flatnonzero(sizes == n) if len(rows) else np.zeros(0, np.int64)
                flat = given.take(pa.array(full)).flatten()
                x = np.asarray(pa.compute.fill_null(flat, 0.0), np.float64).reshape(len(full), n)
                known = ~np.asarray(flat.is_null()).reshape(len(full), n).any(1)
                full, x = full[known], x[known]
                square, cosine = np.zeros(len(x)), np.zeros((len(x), len(rows)))
                for k in range(n):  # in order, as sums of rows are
                    square += x[:, k] * x[:, k]
                length = np.sqrt(square)
                x = np.where((length > 0)[:, None] | np.isnan(length)[:, None], x / np.where(length == 0, 1, length)[:, None], 0.0)
                for k in range(n):
                    cosine += x[:, k, None] * table[None, :, k]
                best = cosine.argmax(1) if len(rows) else np.zeros(0, np.int64)
                label, top, ok = np.full(b.num_rows, labels[0] if len(rows) else 0), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
                label[full], top[full], ok[full] = labels[best], cosine[np.arange(len(x)), best], True
                label = pa.array(label, pa.int64() if wide == "long" else pa.int32(), mask=np.full(b.num_rows, not len(rows)))
                yield pa.record_batch([b.column("cell"), label, pa.array(top, pa.float64(), mask=~ok)], names=["cell", "label", "cosine"])

    return vectors.select("cell", F.transform("embedding", lambda v: v.cast("double")).alias("e")).mapInArrow(each, schema)


def retrieve(query: DataFrame, neighbours: DataFrame, values: DataFrame, tau: float) -> DataFrame:
    """a, feature, value: the neighbours' values weighted by exp(-d^2 / (2 tau^2)), normalised by query.

    A neighbour without a feature counts 0.
    """
    w = neighbours.join(query.select(F.col("cell").alias("a")), "a", "left_semi").withColumn("w", F.exp(-F.col("distance") * F.col("distance") / (2 * tau * tau)))
    total = w.groupBy("a").agg(F.sum("w").alias("total"))
    met = w.join(values.select(F.col("cell").alias("b"), "feature", "count"), "b").groupBy("a", "feature").agg(F.sum(F.col("w") * F.col("count")).alias("s"))
    return met.join(total, "a").select("a", "feature", (F.col("s") / F.col("total")).alias("value"))


def em_proportions(profiles: dict[str, list[float]], rounds: int = 100, tolerance: float = 1e-6):
    """An Arrow function (cell, counts: array) -> (cell, proportions): mixture weights by EM; no counts, no weights."""
    names = list(profiles)
    p = np.array([profiles[n] for n in names], np.float64)
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)

    def fit(x: np.ndarray) -> np.ndarray:
        if not x.sum():
            return np.zeros(len(names))
        pi = np.full(len(names), 1 / len(names))
        for _ in range(rounds):
            mixed = pi @ p
            new = pi * (p @ np.where(mixed > 0, x / np.where(mixed > 0, mixed, 1), 0)) / x.sum()
            if np.abs(new - pi).max() < tolerance:
                return new
            pi = new
        return pi

    def each(batches):
        for b in batches:
            out = [fit(np.asarray(v, np.float64)).tolist() for v in b.column("counts").to_pylist()]
            yield pa.record_batch([b.column("cell"), pa.array(out, pa.list_(pa.float64()))], names=["cell", "proportions"])

    return each, names
