import math

import numpy as np
import pytest
from pairloom.operators import inclusion, spatialgenes, stats


def test_tail_of_two_weights():
    w = np.array([[1, 1], [2, 2], [3, 0], [1e-9, 0.5], [0.7, 0.2], [0.7, 0.2]], float)
    q = np.array([3.0, 0.5, 4.0, 2.0, 0.0, 50.0])
    got = spatialgenes.tail(w, q)
    want = [math.exp(-1.5), math.exp(-0.125), math.erfc(math.sqrt(4 / 6)), math.erfc(math.sqrt(2.0)), 1.0]
    assert np.allclose(got[:5], want, rtol=0, atol=1e-6)
    # an independent value: the outer chi-square's density over the inner one's tail
    z = np.linspace(0, math.sqrt(50 / 0.2), 400_001)
    inner = np.array([math.erfc(math.sqrt(max(50 - 0.2 * v * v, 0) / 1.4)) for v in z])
    f = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * inner
    assert got[5] == pytest.approx(math.erfc(z[-1] / math.sqrt(2)) + 2 * (f[1:] + f[:-1]).sum() / 2 * (z[1] - z[0]), rel=1e-6)


def test_cauchy_rule():
    assert np.allclose(spatialgenes.cauchy(np.array([[0.3, 0.3], [1e-12, 1e-12], [0.9, 0.9]])), [0.3, 1e-12, 0.9], rtol=1e-9)


def test_quantiles_without_sorting(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.integers(0, 3, 500), [1e9, -1e9]])
    monkeypatch.setattr(stats, "SORTED", 320)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double")
    shares = (0.0, 0.2, 0.37, 0.5, 0.61, 1.0)
    assert np.allclose(stats.quantiles(df, shares), np.quantile(x, shares))
    assert stats.quantiles(df.filter("v = 0.25"), (0.3,)) == [0.25] and math.isnan(stats.quantiles(df.limit(0), (0.5,))[0])


def world(seed, n=160, sections=3, features=8):
    rng = np.random.default_rng(seed)
    cells = [(i, int(rng.integers(0, sections)), *rng.uniform(0, 10, 2).tolist()) for i in range(n)]
    edges = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(500)}
    edges = [(a, b) for a, b in edges if cells[a][1] == cells[b][1]]
    x = rng.poisson(0.7, (n, features)).astype(float)
    x[:, 0] = 0
    x[3, 0] = 2  # values in one section only
    x[:, 1] += [c[2] for c in cells]
    x[:, 2] = 0
    return cells, edges, x


def brute(cells, edges, x, tiles):
    section = np.array([c[1] for c in cells])
    xy = np.array([c[2:] for c in cells])
    tile = np.zeros(len(cells), int)
    for s in np.unique(section):
        own = section == s
        low, high = xy[own].min(0), xy[own].max(0)
        place = np.minimum((xy[own] - low) / (high - low) * tiles, tiles - 1).astype(int)
        tile[own] = place[:, 0] * tiles + place[:, 1]

    def value(keep):
        num = den = 0.0
        z = np.zeros_like(x)
        for s in np.unique(section):
            own = keep & (section == s)
            z[own] = x[own] - x[own].mean(0)
        kept = [(a, b) for a, b in edges if keep[a] and keep[b]]
        num, den = sum((z[a] * z[b] for a, b in kept), np.zeros(x.shape[1])), (z[keep] ** 2).sum(0)
        return keep.sum() / len(kept) * num / np.where(den > 1e-12, den, np.inf)

    whole = value(np.ones(len(cells), bool))
    left = np.array([value(~((section == s) & (tile == k))) for s, k in sorted(set(zip(section, tile, strict=True)))])
    g = len(left)
    return whole, np.sqrt((g - 1) / g * ((left - left.mean(0)) ** 2).sum(0))


def frames(spark, cells, edges, x):
    values = [(i, f"f{j}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j] or (i + j) % 3 == 0]
    return spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(cells, "cell long, section int, x double, y double"), spark.createDataFrame(values, "cell long, feature string, value double")


def test_jackknife_equals_brute_force(spark):
    cells, edges, x = world(2)
    got = {r["feature"]: r for r in inclusion.moran(*frames(spark, cells, edges, x), tiles=3).collect()}
    whole, se = brute(cells, edges, x, 3)
    assert sorted(got) == [f"f{j}" for j in range(8) if j != 2]
    for j in set(range(8)) - {0, 2}:
        r = got[f"f{j}"]
        assert r["moran"] == pytest.approx(whole[j], abs=1e-9) and r["se"] == pytest.approx(se[j], rel=1e-6)
        assert r["t"] == pytest.approx((whole[j] + 1 / 159) / se[j], rel=1e-6)
    assert got["f0"]["moran"] == pytest.approx(whole[0], abs=1e-9)


def test_shares_of_signal():
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.normal(0.3, 1.5, 1800), rng.normal(12, 1.5, 200)])
    pi, null = inclusion.shares(t)
    assert 0.8 < null <= 1 and pi[:1800].mean() < 0.03 and pi[1800:].min() > 0.9
    order = np.argsort(t)
    assert (np.diff(pi[order]) >= 0).all()
    calm, _ = inclusion.shares(rng.normal(0, 1, 3000))
    assert (calm > 0.8).mean() < 0.01
    assert inclusion.shares(np.zeros(5))[0].tolist() == [1.0] * 5


def test_planted_spatial_features(spark):
    rng = np.random.default_rng(9)
    n = 300
    cells = [(i, i % 2, *rng.uniform(0, 5, 2).tolist()) for i in range(n)]
    xy = np.array([c[2:] for c in cells])
    x = rng.poisson(2.0, (n, 7)).astype(float)
    x[:, 0] = rng.poisson(np.exp(xy[:, 0] / 2))
    x[:, 1] = rng.poisson(6 * np.exp(-((xy - 2.5) ** 2).sum(1)))
    x[:, 6] = [1.0 + c[1] for c in cells]  # no variance within sections
    _, c, v = frames(spark, cells, [(0, 1)], x)
    got = {r["feature"]: r for r in spatialgenes.test(c, v.withColumnRenamed("value", "count")).collect()}
    assert sorted(got) == [f"f{j}" for j in range(6)]
    assert got["f0"]["q"] < 1e-6 and got["f1"]["q"] < 1e-3 and all(got[f"f{j}"]["q"] > 0.05 for j in range(2, 6))
    assert all(len(r["stats"]) == 11 for r in got.values())
    assert spatialgenes.test(c.limit(0), v.withColumnRenamed("value", "count")).count() == 0
