"""Nuisance fits of the contact effect: designs, cross-fitted ridges, propensities, simulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pool import collected


def fourier(x: np.ndarray, y: np.ndarray, scale: float, n: int, seed: int) -> np.ndarray:
    """n random cosine features of a smooth field with this length scale; draws depend on (seed, scale)."""
    rng = np.random.default_rng([seed, int(scale * 1000)])
    w = rng.normal(size=(2, n)) / scale
    return np.sqrt(2 / n) * np.cos(np.stack([x, y], 1) @ w + rng.uniform(0, 2 * np.pi, n))


def depth_basis(depth: np.ndarray, knots: int = 4) -> np.ndarray:
    """Depth and its excess over inner nearest-rank quantiles."""
    s = np.sort(depth)
    at = [s[int(np.floor(q * (len(s) - 1) + 0.5))] for q in np.arange(1, knots) / knots]
    return np.stack([depth, *[np.maximum(depth - k, 0) for k in at]], 1)


def ridge(gram: np.ndarray, rhs: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients; the first column (the constant) is not penalised."""
    p = np.eye(len(gram)) * penalty
    p[0, 0] = 0
    return np.linalg.solve(gram + p, rhs)


def logistic(x: np.ndarray, t: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    """Logistic ridge by Newton steps, halved while the objective grows."""
    beta = np.zeros(x.shape[1])
    p = np.full(x.shape[1], penalty)
    p[0] = 0

    def loss(b):
        z = x @ b
        return (np.logaddexp(0, z) - t * z).sum() + 0.5 * (p * b * b).sum()

    now = loss(beta)
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-x @ beta))
        w = np.maximum(e * (1 - e), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(p + 1e-9), x.T @ (t - e) - p * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > now:
            size /= 2
        beta = beta + size * step
        new = loss(beta)
        if now - new < 1e-9 * (1 + abs(now)):
            break
        now = new
    return beta


def gram(rows: DataFrame, design: str, y: str, by: list[str]) -> DataFrame:
    """by, i, j, g and by, i, h: sums of x_i x_j and x_i y by key, as one long table (j = -1 holds the right side).

    The outer product is formed row by row in the JVM and summed map-side, so a design of p columns
    shuffles p^2 numbers per key and task.
    """
    x = F.col(design)
    pairs = F.flatten(F.transform(x, lambda a, i: F.transform(x, lambda b, j: F.struct(i.alias("i"), j.alias("j"), (a * b).alias("v")))))
    right = F.transform(x, lambda a, i: F.struct(i.alias("i"), F.lit(-1).alias("j"), (a * F.col(y)).alias("v")))
    flat = rows.select(*by, F.explode(F.concat(pairs, right)).alias("e"))
    return flat.groupBy(*by, F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum("e.v").alias("v"))


def _designed(t, columns: list[str], scale: dict):
    """Of a batch, for each of its pairs: the pair, its rows, their standardised design."""
    names = t["pair"].dictionary_encode()
    code, raw = names.indices.to_numpy(), np.column_stack([t[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
    for k, pair in enumerate(names.dictionary.to_pylist()):
        own = np.flatnonzero(code == k)
        mean, sd = scale[pair]
        yield pair, own, np.column_stack([np.ones(len(own)), (raw[own] - mean) / np.maximum(sd, 1e-9)])


def _summed(rows: DataFrame, columns: list[str], scale: dict, sums) -> dict:
    """{(pair, fold, arm): array}: what sums(pair, x, fold, treated, y) yields for the batches, added within tasks and then over them."""

    def each(batches):
        total = {}
        for t in batches:
            fold, treated, y = (t[c].to_numpy(zero_copy_only=False) for c in ("fold", "treated", "y"))
            for pair, own, x in _designed(t, columns, scale):
                for f, arm, v in sums(pair, x, fold[own], treated[own], y[own]):
                    total[pair, f, arm] = total.get((pair, f, arm), 0) + v
        for (pair, f, arm), v in total.items():
            yield pa.record_batch([pa.array([pair] * len(v), pa.string()), pa.array(np.full(len(v), f, np.int32)), pa.array(np.full(len(v), arm, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["pair", "fold", "arm", "at", "v"])

    flat = rows.mapInArrow(each, "pair string, fold int, arm int, at int, v double").groupBy("pair", "fold", "arm", "at").agg(F.sum("v").alias("v"))
    out = {}
    for r in collected(flat, 5_000_000):
        out.setdefault((r["pair"], r["fold"], r["arm"]), {})[r["at"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _logistics(rows: DataFrame, columns: list[str], scale: dict, keys: list, penalty: float, rounds: int = 50) -> dict:
    """{(pair, fold): coefficients}: logistic() of the rows outside the fold, for all keys at once; a pass over the rows tries one step of each."""
    width = len(columns) + 1
    p = np.full(width, penalty)
    p[0] = 0
    beta, tried = {k: None for k in keys}, {k: np.zeros(width) for k in keys}
    state = {k: {"now": None, "step": None, "size": 1.0, "rounds": 0} for k in keys}
    while tried:
        asked = {}
        for (pair, f), b in tried.items():
            asked.setdefault(pair, []).append((f, b))

        def sums(pair, x, fold, treated, y):
            for f, b in asked.get(pair, []):
                fit = fold != f
                own, t = x[fit], treated[fit].astype(float)
                z = own @ b
                e = 1 / (1 + np.exp(-z))
                w = np.maximum(e * (1 - e), 1e-9)
                yield f, 0, np.concatenate([[(np.logaddexp(0, z) - t * z).sum()], own.T @ (t - e), ((own * w[:, None]).T @ own).ravel()])

        got, going = _summed(rows, columns, scale, sums), {}
        for k, b in tried.items():
            v, s = got[*k, 0], state[k]
            loss = v[0] + 0.5 * (p * b * b).sum()
            if s["now"] is not None and loss > s["now"] and s["size"] > 1e-6:
                s["size"] /= 2
                going[k] = beta[k] + s["size"] * s["step"]
                continue
            before, beta[k], s["now"] = s["now"], b, loss
            if (before is not None and before - loss < 1e-9 * (1 + abs(before))) or s["rounds"] == rounds:
                continue
            s["step"] = np.linalg.solve(v[1 + width :].reshape(width, width) + np.diag(p + 1e-9), v[1 : 1 + width] - p * b)
            s["size"], s["rounds"] = 1.0, s["rounds"] + 1
            going[k] = b + s["step"]
        tried = going
    return beta


def cross_fit(rows: DataFrame, columns: list[str], penalty: float = 1.0) -> DataFrame:
    """pair, cell, fold, treated, y, e, m0, m1 of rows (pair, cell, fold, treated, y and the design's columns).

    For every pair and fold, propensity and outcome are fitted on the other folds. The rows stay where they are: fits take
    sums by pair, fold and arm, a pass over the rows for all ridges and one for each step of all logistic fits.
    """
    schema = "pair string, cell long, fold int, treated int, y double, e double, m0 double, m1 double"
    rows = cut(rows.select("pair", "cell", "fold", "treated", "y", *columns))
    width = len(columns) + 1
    moments = rows.groupBy("pair").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scale = {r["pair"]: tuple(np.array([r[f"{n}_{c}"] for c in columns], float) for n in "ms") for r in collected(moments, 100_000)}

    def grams(pair, x, fold, treated, y):
        for f in np.unique(fold):
            for arm in (0, 1):
                own = (fold == f) & (treated == arm)
                if own.any():
                    yield f, arm, np.concatenate([(x[own].T @ x[own]).ravel(), x[own].T @ y[own]])

    parts = _summed(rows, columns, scale, grams)
    keys = sorted({(pair, f) for pair, f, _ in parts})
    fits, both = {}, []
    for pair, f in keys:
        arms = [[v for (q, g, a), v in parts.items() if q == pair and g != f and a == arm] for arm in (0, 1)]
        fits[pair, f] = [ridge(sum(v)[: width * width].reshape(width, width), sum(v)[width * width :], penalty) if v else None for v in arms]
        if all(arms):
            both.append((pair, f))
    odds = _logistics(rows, columns, scale, both, penalty)

    def each(batches):
        for t in batches:
            e, m, fold = np.full(t.num_rows, np.nan), np.full((2, t.num_rows), np.nan), t["fold"].to_numpy()
            for pair, own, x in _designed(t, columns, scale):
                for f in np.unique(fold[own]):
                    out = fold[own] == f
                    if (pair, f) in odds:
                        e[own[out]] = 1 / (1 + np.exp(-x[out] @ odds[pair, f]))
                    for arm in (0, 1):
                        if fits[pair, f][arm] is not None:
                            m[arm, own[out]] = x[out] @ fits[pair, f][arm]
            yield pa.record_batch([*[t[c] for c in ("pair", "cell", "fold", "treated", "y")], pa.array(e), pa.array(m[0]), pa.array(m[1])], names=["pair", "cell", "fold", "treated", "y", "e", "m0", "m1"])

    return rows.mapInArrow(each, schema)


def identity_bits(vectors: DataFrame, bits: int, dims: int, seed: int) -> DataFrame:
    """cell, bin: the sign bits of `bits` seeded projections of a vector."""
    planes = np.random.default_rng(seed).normal(size=(bits, dims))
    from ..functions.expr import dot

    e = F.transform("embedding", lambda v: v.cast("double"))
    bit = [F.when(dot(F.col("e"), F.array(*[F.lit(float(v)) for v in p])) > 0, 1 << k).otherwise(0) for k, p in enumerate(planes)]
    return vectors.select("cell", e.alias("e")).select("cell", sum(bit[1:], bit[0]).alias("bin"))


def simulate(spark, sections: int, spots: int, genes: int, domains: int, effect: float, seed: int) -> DataFrame:
    """section, spot, x, y, domain, gene, count: planted domains from smooth fields, Poisson counts by keyed draws."""
    schema = "section int, spot int, x double, y double, domain int, gene int, count long"

    def each(batches):
        for b in batches:
            for section in b.column("id").to_pylist():
                rng = np.random.default_rng([seed, section])
                x, y = rng.uniform(0, 10, spots), rng.uniform(0, 10, spots)
                field = np.stack([fourier(x, y, 3.0, 64, seed * 100 + section * 10 + k).sum(1) for k in range(domains)])
                domain = field.argmax(0)
                base = np.random.default_rng([seed, 999]).gamma(2.0, 1.0, (domains, genes))
                lift = np.ones((domains, genes))
                for k in range(domains):
                    lift[k, k * (genes // domains) : (k + 1) * (genes // domains)] = 1 + effect
                rate = (base.mean(0, keepdims=True) * lift)[domain]
                count = rng.poisson(rate)
                s, g = np.nonzero(count)
                yield pa.record_batch(
                    [pa.array(np.full(len(s), section), pa.int32()), pa.array(s.astype(np.int32)), pa.array(x[s]), pa.array(y[s]), pa.array(domain[s].astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(count[s, g].astype(np.int64))],
                    names=["section", "spot", "x", "y", "domain", "gene", "count"],
                )

    return spark.range(sections).mapInArrow(each, schema)


def sup_t(values: np.ndarray, draws: int, seed: int, level: float = 0.95) -> float:
    """The critical value of the largest |t| over a curve, by Gaussian multipliers on cluster sums (clusters x points)."""
    rng = np.random.default_rng(seed)
    c = values - values.mean(0)
    sd = np.sqrt((c * c).sum(0))
    t = np.abs(rng.normal(size=(draws, len(c))) @ c) / np.where(sd > 0, sd, np.inf)
    return float(np.sort(t.max(1))[int(np.floor(level * (draws - 1) + 0.5))])
