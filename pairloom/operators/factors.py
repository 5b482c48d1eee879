"""Spatial factor analysis by coordinate-ascent variational inference, from grouped sums.

    y_nd = mean_d + sum over k of z_nk w_dk + noise_d       noise_d ~ N(0, 1 / tau_d)
    z_k ~ N(0, (I + rho L)^-1)    w_dk = s_dk v_dk    s_dk ~ Bernoulli(pi_k)    v_dk ~ N(0, 1 / alpha_k)

with Gamma priors of alpha_k (automatic relevance) and tau_d, and a Beta prior of pi_k. L is the contact
graph's Laplacian. q(z) is a Gaussian for each cell; its covariance depends on the cell's degree alone,
and its means move together by one step of a bound of the quadratic term (L is at most twice its diagonal), so the evidence
bound cannot fall although all cells move at once. q(w), alpha, pi and tau are updated on the driver
from features x factors numbers, which are bounded.

An iteration is one pass over the contacts and one join with the sparse counts (a missing count is a value of 0, which enters by
sums over features). A cell's counts are packed in one row, once; Arrow batches of them meet the features x factors numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import spectrum
from .numeric import digamma
from .pool import collected

#: Features times factors that the driver holds.
MOST = 5_000_000
A0 = B0 = 1e-3
_psi = np.vectorize(digamma, otypes=[float])


def _lgamma(x: np.ndarray) -> np.ndarray:
    import math

    return np.vectorize(math.lgamma, otypes=[float])(x)


@dataclass
class Weights:
    """q of the loadings and of the precisions. D features x K factors."""

    m: np.ndarray  # mean of v given s = 1
    lam: np.ndarray  # its precision
    c: np.ndarray  # precision of v given s = 0, for each factor
    gamma: np.ndarray  # q(s = 1)
    alpha: tuple[np.ndarray, np.ndarray]  # shape, rate
    pi: tuple[np.ndarray, np.ndarray]
    tau: tuple[np.ndarray, np.ndarray]

    @property
    def mean(self) -> np.ndarray:
        return self.gamma * self.m

    @property
    def variance(self) -> np.ndarray:
        return self.gamma * (self.m**2 + 1 / self.lam) - self.mean**2

    @property
    def slab(self) -> np.ndarray:
        """E[v^2]."""
        return self.gamma * (self.m**2 + 1 / self.lam) + (1 - self.gamma) / self.c

    def noise(self) -> np.ndarray:
        return self.tau[0] / self.tau[1]

    def precision(self) -> np.ndarray:
        """A = sum over features of E[tau w w']."""
        t = self.noise()
        return (self.mean * t[:, None]).T @ self.mean + np.diag((self.variance * t[:, None]).sum(0))


def first_weights(square: np.ndarray, n: int, k: int, seed: int) -> Weights:
    d = len(square)
    spread = np.sqrt(np.maximum(square / n, 1e-12))
    m = np.random.default_rng(seed).normal(size=(d, k)) * spread[:, None]
    return Weights(m, np.full((d, k), 1e6), np.ones(k), np.ones((d, k)), (np.full(k, A0 + d / 2), np.full(k, A0 + d / 2)), (np.full(k, 1.0), np.full(k, 1.0)), (np.full(d, A0 + n / 2), B0 + square / 2 + 1e-9))


def residual(w: Weights, square: np.ndarray, b: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """E||y_d - Z w_d||^2 of each feature."""
    mean = w.mean
    return square - 2 * (mean * b).sum(1) + np.einsum("dj,jk,dk->d", mean, gram, mean) + w.variance @ np.diag(gram)


def update(w: Weights, square: np.ndarray, b: np.ndarray, gram: np.ndarray, n: int) -> Weights:
    """One sweep over factors, then pi, alpha and tau. b: features x factors sums of E[z] y; gram: sum of E[z z']."""
    d, k = w.m.shape
    m, lam, gamma = w.m.copy(), w.lam.copy(), w.gamma.copy()
    tau, alpha = w.noise(), w.alpha[0] / w.alpha[1]
    log_alpha = _psi(w.alpha[0]) - np.log(w.alpha[1])
    log_odds = _psi(w.pi[0]) - _psi(w.pi[1])
    mean = gamma * m
    c = w.c.copy()
    for j in range(k):
        lam[:, j] = tau * gram[j, j] + alpha[j]
        rest = b[:, j] - mean @ gram[:, j] + mean[:, j] * gram[j, j]
        m[:, j] = tau * rest / lam[:, j]
        c[j] = alpha[j]
        score = log_odds[j] + 0.5 * log_alpha[j] - 0.5 * np.log(lam[:, j]) + 0.5 * lam[:, j] * m[:, j] ** 2 - 0.5 * (log_alpha[j] - np.log(c[j]))
        gamma[:, j] = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        mean[:, j] = gamma[:, j] * m[:, j]
    new = Weights(m, lam, c, gamma, w.alpha, w.pi, w.tau)
    new.pi = (1 + gamma.sum(0), 1 + (1 - gamma).sum(0))
    new.alpha = (np.full(k, A0 + d / 2), B0 + new.slab.sum(0) / 2)
    new.tau = (np.full(d, A0 + n / 2), B0 + residual(new, square, b, gram) / 2)
    return new


def _gamma_terms(q: tuple[np.ndarray, np.ndarray]) -> float:
    """E log p - E log q of Gamma variables with prior A0, B0."""
    a, b = q
    log_x, x = _psi(a) - np.log(b), a / b
    prior = A0 * np.log(B0) - _lgamma(np.array(A0)) + (A0 - 1) * log_x - B0 * x
    own = a * np.log(b) - _lgamma(a) + (a - 1) * log_x - b * x
    return float((prior - own).sum())


def bound(w: Weights, square: np.ndarray, b: np.ndarray, gram: np.ndarray, n: int, quadratic: float, entropy: float, log_det: float) -> float:
    """The evidence bound. quadratic: E of sum over k of z_k'(I + rho L)z_k; entropy: of q(z) without its constant; log_det: of I + rho L."""
    k = w.m.shape[1]
    log_tau = _psi(w.tau[0]) - np.log(w.tau[1])
    out = (n / 2 * (log_tau - np.log(2 * np.pi)) - 0.5 * w.noise() * residual(w, square, b, gram)).sum()
    out += 0.5 * k * log_det - 0.5 * quadratic + entropy + n * k / 2  # the constants of prior and entropy: -log 2 pi + log 2 pi e
    g, log_alpha, alpha = np.clip(w.gamma, 1e-300, 1 - 1e-16), _psi(w.alpha[0]) - np.log(w.alpha[1]), w.alpha[0] / w.alpha[1]
    p, q = w.pi
    log_p, log_q = _psi(p) - _psi(p + q), _psi(q) - _psi(p + q)
    out += (g * (log_p - np.log(g)) + (1 - g) * (log_q - np.log1p(-g))).sum()
    out += (0.5 * log_alpha - 0.5 * alpha * w.slab + 0.5 + g * -0.5 * np.log(w.lam) + (1 - g) * -0.5 * np.log(w.c)).sum()
    out += _gamma_terms(w.alpha) + _gamma_terms(w.tau)
    beta = _lgamma(p) + _lgamma(q) - _lgamma(p + q)
    out += (beta - (p - 1) * log_p - (q - 1) * log_q).sum()
    return float(out)


def _linear(names: list[str], rows: np.ndarray) -> list:
    return [sum((F.lit(float(x)) * F.col(c) for x, c in zip(row, names, strict=True)), F.lit(0.0)) for row in rows]


@dataclass
class Fit:
    means: DataFrame  # cell, section, z0, z1, ...
    features: list[str]
    weights: Weights
    bounds: list[float]
    explained: np.ndarray  # by factor, the share of the features' sum of squares

    def active(self, least: float = 1e-3) -> list[int]:
        """The factors that explain something."""
        return [k for k, x in enumerate(self.explained) if x >= least]


def _packed(values: DataFrame, names: list[str]) -> DataFrame:
    """cell, at (numbers of features), vals: a row a cell."""
    table = values.sparkSession.createDataFrame(list(enumerate(names)), "at int, feature string")
    rows = values.join(F.broadcast(table), "feature").groupBy("cell").agg(F.collect_list(F.struct("at", "value")).alias("own"))
    return cut(rows.select(F.col("cell").cast("long").alias("cell"), F.col("own.at").alias("at"), F.col("own.value").alias("vals")))


def _opened(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of packed rows: the row, feature and value of each count."""
    lists = t.column("at")
    return np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), t.column("vals").flatten().to_numpy()


def _pulls(table: np.ndarray, to: list[str]):
    """By cell, the sums of its values times the rows of the table (features x factors numbers, checked)."""

    def each(batches):
        for t in batches:
            row, at, v = _opened(t)
            sums = [np.bincount(row, weights=v * table[at, j], minlength=t.num_rows) for j in range(len(to))]
            yield pa.record_batch([t.column("cell"), *map(pa.array, sums)], names=["cell", *to])

    return each


def _pushes(features: int, z: list[str]):
    """By feature, a task's sums of values times the cells' means."""

    def each(batches):
        out, seen = np.zeros((len(z), features)), np.zeros(features, bool)
        for t in batches:
            row, at, v = _opened(t)
            seen[at] = True
            for j, c in enumerate(z):
                out[j] += np.bincount(at, weights=v * t.column(c).to_numpy()[row], minlength=features)
        here = np.flatnonzero(seen)
        if len(here):
            yield pa.record_batch([pa.array(here.astype(np.int32)), *[pa.array(x[here]) for x in out]], names=["at", *z])

    return each


def fit(matrix: DataFrame, values: DataFrame, k: int, rho: float, rounds: int, tol: float = 1e-6, log_det: float = 0.0, seed: int = 0) -> Fit:
    """matrix: spectrum.links() of all cells; values: cell, feature, value (missing: 0); ends after `rounds` or when the bound gains less than tol of itself."""
    matrix = cut(matrix)
    cells = matrix.filter("src = dst").select("section", F.col("src").alias("cell"))
    values = cut(values.select("cell", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value")).join(cells.select("cell"), "cell"))
    n = cells.count()
    by = collected(values.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss")), MOST // k)
    by = sorted(by, key=lambda r: r["feature"])
    names = [r["feature"] for r in by]
    centre = np.array([r["s"] for r in by]) / max(n, 1)
    square = np.array([r["ss"] for r in by]) - n * centre**2
    z, lz, r = ([f"{c}{j}" for j in range(k)] for c in ("z", "l", "r"))
    w = first_weights(square, max(n, 1), k, seed)
    degrees = matrix.filter("src = dst").select("section", F.col("src").alias("cell"), F.col("w").alias("degree"))
    now = cut(degrees.select("section", "cell", "degree", *[F.lit(0.0).alias(c) for c in [*z, *lz]]))
    bounds: list[float] = []
    if not n or not names:
        return Fit(now.select("section", "cell", *z), names, w, bounds, np.zeros(k))
    packed = _packed(values, names)
    for turn in range(rounds + 1):
        a = w.precision()
        level, turned = np.linalg.eigh(a)
        pull = packed.mapInArrow(_pulls(w.mean * w.noise()[:, None], r), "cell long, " + ", ".join(f"{c} double" for c in r))
        level_off = (w.mean * w.noise()[:, None]).T @ centre
        held = now.join(pull, "cell", "left")
        slope = [F.coalesce(F.col(r[j]), F.lit(0.0)) - float(level_off[j]) - F.col(z[j]) - x - rho * F.col(lz[j]) for j, x in enumerate(_linear(z, a))]
        held = held.select("section", "cell", "degree", *z, *[s.alias(f"g{j}") for j, s in enumerate(slope)])
        turned_in = [(x / (1 + 2 * rho * F.col("degree") + float(e))).alias(f"h{i}") for i, (x, e) in enumerate(zip(_linear([f"g{j}" for j in range(k)], turned.T), level, strict=True))]
        held = held.select("section", "cell", "degree", *z, *turned_in)
        moved = held.select("cell", "degree", *[(F.col(c) + x).alias(c) for c, x in zip(z, _linear([f"h{i}" for i in range(k)], turned), strict=True)])
        # the product serves the sums of the new means and covariances and the next round
        now = cut(spectrum.product(matrix, moved, z, lz, ["degree"]))
        spread = [1 / (1 + rho * F.col("degree") + float(e)) for e in level]
        got = now.agg(
            *[F.sum(F.col(z[i]) * F.col(z[j])).alias(f"zz{i}_{j}") for i in range(k) for j in range(i, k)],
            *[F.sum(c).alias(f"s{c}") for c in z],
            F.sum(sum((F.col(z[j]) * (F.col(z[j]) + rho * F.col(lz[j])) for j in range(k)), F.lit(0.0))).alias("quad"),
            *[F.sum(s).alias(f"v{i}") for i, s in enumerate(spread)],
            F.sum(sum(((1 + rho * F.col("degree")) * s for s in spread), F.lit(0.0))).alias("trace"),
            F.sum(sum((0.5 * F.log(s) for s in spread), F.lit(0.0))).alias("entropy"),
        ).first()
        gram = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = got[f"zz{i}_{j}"]
        gram += (turned * np.array([got[f"v{i}"] for i in range(k)])) @ turned.T
        b = np.zeros((len(names), k))
        parts = packed.join(now.select("cell", *z), "cell").mapInArrow(_pushes(len(names), z), "at int, " + ", ".join(f"{c} double" for c in z))
        for row in parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in z]).toLocalIterator():
            b[row["at"]] = [row[c] for c in z]
        b -= centre[:, None] * np.array([got[f"s{c}"] for c in z])
        w = update(w, square, b, gram, n)
        bounds.append(bound(w, square, b, gram, n, got["quad"] + got["trace"], got["entropy"], log_det))
        if turn and bounds[-1] - bounds[-2] < tol * abs(bounds[-1]):
            break
    explained = (w.mean**2 * np.diag(gram)).sum(0) / max(square.sum(), 1e-300)
    return Fit(now.select("section", "cell", *z), names, w, bounds, explained)
