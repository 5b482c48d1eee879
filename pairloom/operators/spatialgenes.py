"""Spatially variable features: a covariance test against eleven transforms of the coordinates.

A kernel is a pair of columns S made from each cell's coordinates, centred and scaled within its section: the coordinates
themselves, five Gaussian transforms exp(-s^2 / (2 c^2)) and five cosine transforms cos(2 pi s / c), c for each
axis at a quantile of |s|. With H centring within sections, y'HS (S'S)^-1 S'Hy / (y'Hy / n) is, without
association, a sum of chi-squares weighted by the eigenvalues of (S'S)^-1 S'HS. The kernels' p-values are combined by
Cauchy's rule; q is Benjamini and Yekutieli's.

The sparse counts are joined once with 22 numbers a cell; sums by feature and section give everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import stats

QUANTILES = (0.2, 0.4, 0.6, 0.8, 1.0)
KERNELS = 1 + 2 * len(QUANTILES)
#: Nodes of the quarter circle over which a tail is integrated.
NODES = 200


def tail(weights: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P(w1 Z1^2 + w2 Z2^2 > q) for rows of two weights (0 or more) and q: the mean over angles t of
    exp(-q / (2 (w1 cos^2 t + w2 sin^2 t))), as a normal pair's squared radius is exponential whatever its angle.

    A quarter circle is enough. It is cut by Gauss-Legendre nodes in u, t = pi / 2 u^3 from the axis of the smaller
    weight, where the integrand turns sharply if the weights are far apart.
    """
    w, q = np.asarray(weights, float), np.asarray(q, float)
    x, mass = np.polynomial.legendre.leggauss(NODES)
    u, mass = (x + 1) / 2, mass / 2
    t = np.pi / 2 * u**3
    big, small = w.max(axis=1)[:, None], w.min(axis=1)[:, None]
    spread = np.maximum(2 * (small * np.cos(t) ** 2 + big * np.sin(t) ** 2), 1e-300)
    return np.where(q <= 0, 1.0, (np.exp(-np.maximum(q, 0)[:, None] / spread) * 3 * u**2 * mass).sum(axis=1))


def cauchy(p: np.ndarray) -> np.ndarray:
    """Each row's p-values combined with equal weights."""
    t = (1 / np.tan(np.clip(p, 1e-300, 1) * np.pi)).mean(axis=1)
    return np.where(t > 1, np.arctan(1 / np.where(t > 1, t, 1)) / np.pi, 0.5 - np.arctan(t) / np.pi)


def _standardised(cells: DataFrame) -> DataFrame:
    """cell, section, s0, s1: coordinates centred and scaled within sections (a constant one is only centred)."""
    by = cells.groupBy("section").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    met = cells.join(by, "section")
    return met.select("cell", "section", *[((F.col(c) - F.col(f"mean{c}")) / F.when(F.col(f"sd{c}") > 0, F.col(f"sd{c}")).otherwise(1.0)).alias(f"s{i}") for i, c in enumerate("xy")])


def _columns(scales: list[list[float]]) -> list:
    """The 22 kernel columns; scales[axis][quantile]."""
    out = [F.col("s0"), F.col("s1")]
    for k in range(len(QUANTILES)):
        out += [F.exp(-F.col(f"s{i}") ** 2 / (2 * scales[i][k] ** 2)) for i in (0, 1)]
    for k in range(len(QUANTILES)):
        out += [F.cos(2 * np.pi * F.col(f"s{i}") / scales[i][k]) for i in (0, 1)]
    return [c.alias(f"k{j}") for j, c in enumerate(out)]


def _nulls(whole: list[np.ndarray], within: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each kernel, (S'S)^-1 and the null's two weights."""
    inverse, weights = [], []
    for g, a in zip(whole, within, strict=True):
        w = np.linalg.pinv(g, rcond=1e-12, hermitian=True)
        level, turned = np.linalg.eigh(w)
        root = (turned * np.sqrt(np.maximum(level, 0))) @ turned.T
        own = np.linalg.eigvalsh(root @ a @ root)
        inverse.append(w)
        weights.append(np.where(own > 1e-10, own, 0.0))
    return inverse, weights


def test(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """feature, stats (array of 11), p, q, for the features with variance within sections. cells: cell, section, x, y; counts: cell, feature, count (missing: 0)."""
    s = cut(_standardised(cells.select("cell", "section", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    n = s.count()
    schema = "feature string, stats array<double>, p double"
    if not n:
        return s.sparkSession.createDataFrame([], schema + ", q double")
    scales = [[max(x, 1e-12) for x in stats.quantiles(s.select(F.abs(f"s{i}").alias("v")), QUANTILES)] for i in (0, 1)]
    names = [f"k{j}" for j in range(2 * KERNELS)]
    raw = s.select("cell", "section", *_columns(scales))
    means = raw.groupBy("section").agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"m_{c}") for c in names])
    held = cut(raw.join(means, "section").select("cell", "section", "size", *names, *[(F.col(c) - F.col(f"m_{c}")).alias(f"h_{c}") for c in names]))
    parts = [(k, i, j) for k in range(KERNELS) for i in (0, 1) for j in range(i, 2)]
    got = held.agg(*[F.sum(F.col(f"{h}k{2 * k + i}") * F.col(f"{h}k{2 * k + j}")).alias(f"{h}{k}_{i}{j}") for h in ("", "h_") for k, i, j in parts]).first()
    full = lambda h, k: np.array([[got[f"{h}{k}_00"], got[f"{h}{k}_01"]], [got[f"{h}{k}_01"], got[f"{h}{k}_11"]]])
    inverse, weights = _nulls([full("", k) for k in range(KERNELS)], [full("h_", k) for k in range(KERNELS)])
    met = counts.select("cell", F.col("feature").cast("string").alias("feature"), F.col("count").cast("double").alias("v")).join(held.select("cell", "section", "size", *[f"h_{c}" for c in names]), "cell")
    by = met.groupBy("feature", "section").agg(F.first("size").alias("size"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("ss"), *[F.sum(F.col("v") * F.col(f"h_{c}")).alias(c) for c in names])
    rows = by.groupBy("feature").agg(F.sum("ss").alias("ss"), (F.sum("ss") - F.sum(F.col("s") ** 2 / F.col("size"))).alias("spread"), *[F.sum(c).alias(c) for c in names])

    def each(batches):
        for b in batches:
            u = np.stack([b.column(c).to_numpy() for c in names], 1).reshape(-1, KERNELS, 2)
            t = np.einsum("fki,kij,fkj->fk", u, np.array(inverse), u) / (b.column("spread").to_numpy() / n)[:, None]
            p = np.array([tail(np.array(weights), row) for row in t]).reshape(-1, KERNELS)
            yield pa.record_batch([b.column("feature"), pa.array(t.tolist(), pa.list_(pa.float64())), pa.array(cauchy(p), pa.float64())], names=["feature", "stats", "p"])

    tested = rows.filter(F.col("spread") > 1e-12 * F.col("ss")).select("feature", "spread", *names).mapInArrow(each, schema)
    return stats.by_adjust(tested.withColumn("family", F.lit(0)), ["family"], "p", "q").drop("family")
