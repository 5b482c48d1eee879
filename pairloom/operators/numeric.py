"""Small fits on the driver over aggregates, and kernels over Arrow batches: weights, incidence, placements, factors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import graph


def digamma(x: float) -> float:
    """By recurrence up to 6 and the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def fisher_weights(moments: DataFrame, mean_depth: float) -> DataFrame:
    """feature, weight = 1 / (1 + share depth phi(mu)), phi from a trend ln phi ~ ln mean over features of positive excess variance.

    moments: feature, mean, variance. The trend is the least-squares line, from five sums.
    """
    excess = (F.col("variance") - F.col("mean")) / (F.col("mean") * F.col("mean"))
    ok = moments.filter("mean > 0").withColumn("phi", excess)
    x, y = F.log("mean"), F.log("phi")
    use = F.when(F.col("phi") > 0, 1)
    r = ok.agg(F.count(use).alias("n"), F.sum(use * x).alias("x"), F.sum(use * y).alias("y"), F.sum(use * x * x).alias("xx"), F.sum(use * x * y).alias("xy"), F.sum("mean").alias("m")).first()
    spread = (r["xx"] or 0) - (r["x"] or 0) ** 2 / max(r["n"], 1)
    slope = ((r["xy"] - r["x"] * r["y"] / r["n"]) / spread) if r["n"] > 1 and spread > 1e-12 else 0.0
    base = (r["y"] - slope * r["x"]) / r["n"] if r["n"] else float("-inf")
    phi = F.exp(F.lit(slope) * F.log("mean") + base) if r["n"] else F.lit(0.0)
    return ok.select("feature", (1 / (1 + F.col("mean") / (r["m"] or 1.0) * mean_depth * phi)).alias("weight"))


def log_incidence(membership: DataFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """k, l, psi: psi(a + S) - ln(b + W) of pairs of communities; S the contacts' shares, W what independence expects."""

    @F.pandas_udf("double")
    def psi(s):  # one series
        return s.map(digamma)

    one = membership.groupBy("k", "l").agg(F.sum("s").alias("S"))
    rows, columns = F.sum("S").over(W.partitionBy("k")), F.sum("S").over(W.partitionBy("l"))
    expected = rows * columns / F.sum("S").over(W.partitionBy())
    return one.withColumn("w", expected).select("k", "l", (psi(F.col("S") + a) - F.log(F.col("w") + b)).alias("psi"))


def place(profiles: np.ndarray, rounds: int = 30, ridge: float = 1.0):
    """An Arrow function (cell, counts) -> (cell, latent, intercept): Poisson fits of counts ~ exp(c + B z) with a normal prior.

    The intercept has a closed form given z; z moves by Newton steps, halved while the objective grows.
    """
    b = np.asarray(profiles, np.float64)  # dims x features

    def fit(x):
        z = np.zeros(len(b))
        if not x.sum():
            return z, 0.0

        def value(z):
            e = b.T @ z
            return x.sum() * (e.max() + np.log(np.exp(e - e.max()).sum())) - x @ e + 0.5 * ridge * z @ z

        for _ in range(rounds):
            e = b.T @ z
            p = np.exp(e - e.max())
            p /= p.sum()
            grad = x.sum() * (b @ p) - b @ x + ridge * z
            hess = x.sum() * ((b * p) @ b.T - np.outer(b @ p, b @ p)) + ridge * np.eye(len(b))
            step, size = np.linalg.solve(hess, grad), 1.0
            while size > 1e-6 and value(z - size * step) > value(z):
                size /= 2
            z = z - size * step
            if np.abs(size * step).max() < 1e-8:
                break
        e = b.T @ z
        return z, float(np.log(x.sum()) - e.max() - np.log(np.exp(e - e.max()).sum()))

    def each(batches):
        for t in batches:
            got = [fit(np.asarray(v, np.float64)) for v in t.column("counts").to_pylist()]
            yield pa.record_batch([t.column("cell"), pa.array([z.tolist() for z, _ in got], pa.list_(pa.float64())), pa.array([c for _, c in got], pa.float64())], names=["cell", "latent", "intercept"])

    return each


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """A local quadratic fit at every x, with tricube weights over the nearest share of points."""
    n, k = len(x), max(3, int(np.ceil(span * len(x))))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - x[i])
        near = np.argsort(d, kind="stable")[:k]
        h = max(d[near].max(), 1e-12)
        w = np.sqrt(np.clip(1 - (d[near] / h) ** 3, 0, None) ** 3)
        m = np.stack([np.ones(k), x[near] - x[i], (x[near] - x[i]) ** 2], 1)
        out[i] = np.linalg.lstsq(m * w[:, None], y[near] * w, rcond=None)[0][0]
    return out


def standardised_variance(counts: DataFrame, moments: DataFrame, n_cells: int, most: int = 100_000) -> DataFrame:
    """feature, variance: of (x - mean) / sd clipped at sqrt(N), sd from a loess of ln variance on ln mean.

    Moments (one row per feature, at most `most`) are fitted on the driver; counts are read once, and
    the zeros' share is added in closed form.
    """
    rows = moments.filter("mean > 0 AND variance > 0").select("feature", "mean", "variance").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many features for one trend")
    m, v = np.array([r["mean"] for r in rows]), np.array([r["variance"] for r in rows])
    sd = np.sqrt(np.exp(loess(np.log(m), np.log(v))))
    table = counts.sparkSession.createDataFrame([(r["feature"], float(a), float(b)) for r, a, b in zip(rows, m, sd, strict=True)], "feature string, mean double, sd double")
    z = F.least((F.col("count") - F.col("mean")) / F.col("sd"), F.lit(math.sqrt(n_cells)))
    got = counts.join(table, "feature").groupBy("feature", "mean", "sd").agg(F.sum(z * z).alias("q"), F.count(F.lit(1)).alias("k"))
    zero = F.col("mean") / F.col("sd")
    return got.select("feature", ((F.col("q") + (n_cells - F.col("k")) * zero * zero) / (n_cells - 1)).alias("variance"))


def smoothed(edges: DataFrame, values: DataFrame, rho: float, rounds: int) -> DataFrame:
    """cell, feature, value of (I + rho L)^-1 x by Jacobi rounds; L is the contacts' Laplacian.

    Each round is one join of contacts with values, checkpointed.
    """
    ends = cut(graph.both_ways(edges))
    degree = ends.groupBy(F.col("src").alias("cell")).agg(F.count(F.lit(1)).alias("deg"))
    base = cut(values.join(degree, "cell", "left").select("cell", "feature", F.col("value").alias("x"), F.coalesce("deg", F.lit(0)).alias("deg")))
    now = base.select("cell", "feature", F.col("x").alias("value"))
    for _ in range(rounds):
        near = ends.join(now.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "feature").agg(F.sum("value").alias("s"))
        now = cut(base.join(near, ["cell", "feature"], "full").select("cell", "feature", ((F.coalesce("x", F.lit(0.0)) + rho * F.coalesce("s", F.lit(0.0))) / (1 + rho * F.coalesce("deg", F.lit(0)))).alias("value")))
    return now


def heaviest_first(sizes: list[tuple[str, float]], bins: int) -> dict[str, int]:
    """Deal items, the heaviest first, to the least filled bin; ties to the lowest bin."""
    load, out = [0.0] * bins, {}
    for name, size in sorted(sizes, key=lambda s: (-s[1], s[0])):
        k = load.index(min(load))
        out[name] = k
        load[k] += size
    return out


def silverman(x: np.ndarray) -> float:
    """0.9 min(sd, IQR / 1.34) n^(-1/5)."""
    q = np.sort(x)
    iqr = q[int(np.floor(0.75 * (len(q) - 1) + 0.5))] - q[int(np.floor(0.25 * (len(q) - 1) + 0.5))]
    spread = min(x.std(ddof=1), iqr / 1.34) if iqr > 0 else x.std(ddof=1)
    return float(0.9 * spread * len(x) ** -0.2)


def zip_by_moments(mean: float, detected: float) -> tuple[float, float]:
    """(p, rate) of a zero-inflated Poisson with this mean and share above zero; all produce where Poisson alone suffices."""
    if mean <= 0 or detected <= 0:
        return 0.0, 0.0
    if detected >= 1 - math.exp(-mean):
        return 1.0, mean
    low, high = 1e-9, 1e6
    for _ in range(200):
        r = math.sqrt(low * high)
        low, high = (r, high) if mean / r * (1 - math.exp(-r)) > detected else (low, r)
    return mean / low, low


def segment(edges: DataFrame, counts: DataFrame, labels: DataFrame, smooth: float, rounds: int) -> DataFrame:
    """cell, label: hard Poisson mixture with a neighbour field - each round re-estimates rates and reassigns cells.

    A variational update of a hidden Markov field with point assignments: a cell's score for a label
    is its counts' log-likelihood under the label's rates plus smooth times its neighbours with it.
    """
    ends, now = cut(graph.both_ways(edges)), cut(labels.select("cell", "label"))
    total = counts.groupBy("cell").agg(F.sum("count").alias("depth"))
    for _ in range(rounds):
        depth = now.join(total, "cell").groupBy("label").agg(F.sum("depth").alias("d"))
        rate = counts.join(now, "cell").groupBy("label", "feature").agg(F.sum("count").alias("c")).join(depth, "label")
        every = depth.select("label", "d")
        rate = counts.select("feature").distinct().join(F.broadcast(every)).join(rate.select("label", "feature", "c"), ["label", "feature"], "left")
        rate = rate.select("label", "feature", F.log((F.coalesce("c", F.lit(0.0)) + 1) / (F.col("d") + 1)).alias("lr"))
        fit = counts.join(F.broadcast(rate), "feature").groupBy("cell", "label").agg(F.sum(F.col("count") * F.col("lr")).alias("ll"))
        near = ends.join(now.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "label").agg(F.count(F.lit(1)).alias("k"))
        scored = fit.join(near, ["cell", "label"], "left").withColumn("s", F.col("ll") + smooth * F.coalesce("k", F.lit(0)))
        now = cut(scored.groupBy("cell").agg(F.max(F.struct("s", (-F.col("label")).alias("l"))).alias("b")).select("cell", (-F.col("b.l")).alias("label")))
    return now
