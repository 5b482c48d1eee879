"""Spatial domains by variational inference: a Poisson mixture with a Potts coupling of neighbours and stick-breaking weights.

    y_ig | c_i = k ~ Poisson(s_i lambda_kg)    lambda_kg ~ Gamma(A, B)    s_i: the cell's total over the mean total
    p(c) proportional to prod_i pi_{c_i} prod over contacts exp(w_ij [c_i = c_j])    pi by sticks v_k ~ Beta(1, alpha)

The posterior is taken apart into phi_i (a distribution for each cell), a Gamma for each rate and a Beta for each stick. The
coupling is a sum of phi_i . phi_j, which cells that all move at once could lower; with the degree d_i = sum_j w_ij, a step that
weighs the wished change against d_i times its divergence from the cell's present phi bounds it from below:

    phi_i  proportional to  exp((data_ik + E log pi_k + sum_j w_ij phi_jk + d_i log phi_ik) / (1 + d_i))

so the evidence bound (up to the constant of the Potts prior) never falls. A round is one pass over the contacts, one join of sparse counts
with a table of domains x features, and sums by feature; phi is K columns of one table. Domains x features numbers are on the driver, at most MOST.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, settled
from .factors import _lgamma, _psi
from .pool import collected

#: Domains times features that the driver holds and sends.
MOST = 2_000_000
# The priors of rates and of the sticks, and the least share at which a domain lives.
A = B = 1e-2
ALPHA = 1.0
DEAD = 1e-6
#: phi is kept from 0, so that its logarithm stays a number.
LEAST = 1e-12
#: Candidates for each starting profile.
SEEDS = 6


@dataclass
class Fit:
    cells: DataFrame  # cell, label, p (of the label), phi array<double>
    features: list[str]
    rates: np.ndarray  # living domains x features
    weights: np.ndarray  # expected share of each living domain
    bounds: list[float]


def _gammas(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """E, E log, and the bound's part of Gamma(a, b) under the prior."""
    mean, log = a / b, _psi(a) - np.log(b)
    prior = A * np.log(B) - _lgamma(np.array(A)) + (A - 1) * log - B * mean
    return mean, log, float((prior - (a * np.log(b) - _lgamma(a) + (a - 1) * log - b * mean)).sum())


def _sticks(mass: np.ndarray) -> tuple[np.ndarray, float]:
    """E log pi and the bound's part of the sticks, from the cells of each domain; the last stick takes all that is left."""
    if len(mass) == 1:
        return np.zeros(1), 0.0
    a, b = 1 + mass[:-1], ALPHA + mass[::-1].cumsum()[::-1][1:]
    log_v, log_u = _psi(a) - _psi(a + b), _psi(b) - _psi(a + b)
    log_pi = np.append(log_v, 0.0) + np.append(0.0, log_u.cumsum())
    beta = _lgamma(a) + _lgamma(b) - _lgamma(a + b)
    return log_pi, float((np.log(ALPHA) + (ALPHA - 1) * log_u + beta - (a - 1) * log_v - (b - 1) * log_u).sum())


def _sum(items: list):
    return sum(items[1:], items[0])


def _first(base: DataFrame, ends: DataFrame, values: DataFrame, at: dict[str, int], centre: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gammas of k profiles: of SEEDS k cells by hash, each with its neighbours, the most different ones, drawn to the mean."""
    some = base.filter("s > 0").orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(SEEDS * k).select("cell")  # starting points, not what is fitted
    around = cut(ends.join(some, "cell").select(F.col("cell").alias("seed"), F.col("src").alias("cell")).unionByName(some.select(F.col("cell").alias("seed"), "cell")))
    size = around.join(base.select("cell", "s"), "cell").groupBy("seed").agg(F.sum("s").alias("s"))
    sums = around.join(values, "cell").groupBy("seed", "feature").agg(F.sum("count").alias("c"))
    order = {r["seed"]: (i, r["s"]) for i, r in enumerate(sorted(collected(size, SEEDS * k), key=lambda r: r["seed"]))}
    taken = np.zeros((len(order), len(at)))
    for r in collected(sums, SEEDS * MOST):
        taken[order[r["seed"]][0], at[r["feature"]]] = r["c"]
    sized = np.array([s for _, s in order.values()])
    rates = (taken + centre) / (sized + 1)[:, None]
    off = rates * np.log(rates / centre) - rates + centre  # the divergence from the mean, then from the nearest chosen
    chosen = [int(off.sum(1).argmax())]
    while len(chosen) < min(k, len(rates)):
        apart = np.min([(rates * np.log(rates / rates[c]) - rates + rates[c]).sum(1) for c in chosen], axis=0)
        apart[chosen] = -1
        chosen.append(int(apart.argmax()))
    a = np.vstack([taken[chosen] + centre, np.tile(centre, (k - len(chosen), 1))])
    b = np.concatenate([sized[chosen] + 1, np.ones(k - len(chosen))])
    return a, b[:, None] * np.ones_like(a)


def fit(cells: DataFrame, edges: DataFrame, counts: DataFrame, k: int, smooth: float = 1.0, rounds: int = 50, tol: float = 1e-6, seed: int = 0) -> Fit:
    """cells: cell; edges: a, b and, if given, weight (else 1), each once or more; counts: cell, feature, count (missing: 0).

    Starts from the profiles of k cells with their neighbours, chosen apart from each other. Ends after `rounds`, or when the bound gains less than tol of itself. Domains that no cell
    gives DEAD are dropped, the others renumbered by size. Cells without counts follow their neighbours. Without cells or counts all cells have
    label 0. Edges of unknown cells, loops and nulls count for nothing.
    """
    spark = cells.sparkSession
    cells = cut(cells.select("cell").filter("cell IS NOT NULL").distinct())
    n = cells.count()
    values = counts.select("cell", F.col("feature").cast("string").alias("feature"), F.col("count").cast("double").alias("count")).filter("count > 0 AND feature IS NOT NULL").join(cells, "cell")
    values = cut(values.groupBy("cell", "feature").agg(F.sum("count").alias("count")))
    by = sorted(collected(values.groupBy("feature").agg(F.sum("count").alias("s")), MOST // k), key=lambda r: r["feature"])
    names, sums = [r["feature"] for r in by], np.array([r["s"] for r in by])
    if not n or not names:
        out = cells.select("cell", F.lit(0).alias("label"), F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("phi"))
        return Fit(out, names, np.zeros((1, 0)), np.ones(1), [])
    total = sums.sum()
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    near = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (weight * smooth).alias("w")).filter("w > 0").groupBy("a", "b").agg(F.max("w").alias("w"))
    near = near.join(cells.withColumnRenamed("cell", "a"), "a", "left_semi").join(cells.withColumnRenamed("cell", "b"), "b", "left_semi")
    ends = cut(near.select(F.col("a").alias("src"), F.col("b").alias("cell"), "w").unionByName(near.select(F.col("b").alias("src"), F.col("a").alias("cell"), "w")))
    degree = ends.groupBy("cell").agg(F.sum("w").alias("d"))
    # fact: sum over features of log y!, which is no part of what is fitted but of the bound
    depth = values.groupBy("cell").agg((F.sum("count") * (n / total)).alias("s"), F.sum(F.expr("count * ln(count) - count + 0.5 * ln(6.283185307179586 * count)")).alias("fact"))
    base = cut(cells.join(depth, "cell", "left").join(degree, "cell", "left").na.fill(0.0))
    size, fact = base.agg(F.sum("s"), F.sum("fact")).first()
    log_s = values.join(base.filter("s > 0").select("cell", F.log("s").alias("ls")), "cell").agg(F.sum(F.col("count") * F.col("ls"))).first()[0]
    phi, grid = [f"p{j}" for j in range(k)], [f"g{j}" for j in range(k)]
    at = {x: i for i, x in enumerate(names)}
    a, b = _first(base, ends, values, at, sums / n, k, seed)
    now, mass, bounds = base.select("cell", *[F.lit(1.0 / k).alias(c) for c in phi]), np.full(k, n / k), []
    log_pi = np.log(np.full(k, 1.0 / k))
    mean, log, _ = _gammas(a, b)
    for turn in range(rounds):
        table = spark.createDataFrame([(x, *map(float, row)) for x, row in zip(names, log.T, strict=True)], ["feature", *grid])
        data = values.join(F.broadcast(table), "feature").groupBy("cell").agg(*[F.sum(F.col("count") * F.col(g)).alias(g) for g in grid])  # domains x features, checked
        around = ends.join(now.withColumnRenamed("cell", "src"), "src").groupBy("cell").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"w{j}") for j, c in enumerate(phi)])
        met = base.select("cell", "s", "d").join(now, "cell").join(data, "cell", "left").join(around, "cell", "left").na.fill(0.0)
        held = [F.col(g) - F.col("s") * float(mean[j].sum()) + float(log_pi[j]) for j, g in enumerate(grid)]
        wish = [(h + F.col(f"w{j}") + F.col("d") * F.log(F.col(c))) / (1 + F.col("d")) for j, (h, c) in enumerate(zip(held, phi, strict=True))]
        met = met.select("cell", "s", *[x.alias(f"x{j}") for j, x in enumerate(wish)]).withColumn("top", F.greatest(*[F.col(f"x{j}") for j in range(k)]) if k > 1 else F.col("x0"))
        met = met.select("cell", "s", *[F.greatest(F.exp(F.col(f"x{j}") - F.col("top")), F.lit(LEAST)).alias(f"x{j}") for j in range(k)])
        all_ = _sum([F.col(f"x{j}") for j in range(k)])
        now = settled(met.select("cell", "s", *[(F.col(f"x{j}") / all_).alias(c) for j, c in enumerate(phi)]))
        got = now.agg(*[F.sum(c).alias(c) for c in phi], *[F.sum(F.col("s") * F.col(c)).alias(f"s{j}") for j, c in enumerate(phi)], F.sum(_sum([-F.col(c) * F.log(c) for c in phi])).alias("entropy")).first()
        mass, sized = np.array([got[c] for c in phi]), np.array([got[f"s{j}"] for j in range(k)])
        now = now.drop("s")
        taken = np.zeros((k, len(names)))
        for r in collected(values.join(now, "cell").groupBy("feature").agg(*[F.sum(F.col("count") * F.col(c)).alias(c) for c in phi]), MOST // k):
            taken[:, at[r["feature"]]] = [r[c] for c in phi]
        a, b = A + taken, (B + sized)[:, None] * np.ones_like(taken)
        mean, log, own = _gammas(a, b)
        log_pi, sticks = _sticks(mass)
        other = now.select(F.col("cell").alias("src"), *[F.col(c).alias(f"o{j}") for j, c in enumerate(phi)])
        pull = ends.filter("src < cell").join(now, "cell").join(other, "src").agg(F.sum(F.col("w") * _sum([F.col(c) * F.col(f"o{j}") for j, c in enumerate(phi)]))).first()[0] or 0.0
        fitted = (taken * log).sum() - (sized[:, None] * mean).sum() + (log_s or 0.0) - fact
        bounds.append(float(fitted + mass @ log_pi + pull + got["entropy"] + own + sticks))
        if turn and bounds[-1] - bounds[-2] < tol * abs(bounds[-1]):
            break
    most = now.agg(*[F.max(c).alias(c) for c in phi]).first()
    alive = sorted((j for j in range(k) if most[phi[j]] > DEAD * 10), key=lambda j: (-mass[j], j))
    left = _sum([F.col(phi[j]) for j in alive])
    out = now.select("cell", F.array(*[F.col(phi[j]) / left for j in alive]).alias("phi"))
    out = out.withColumn("p", F.array_max("phi")).select("cell", (F.array_position("phi", F.col("p")) - 1).cast("int").alias("label"), "p", "phi")
    return Fit(out, names, mean[alive], mass[alive] / n, bounds)
