import numpy as np
from pairloom.operators import factors, spectrum


def planted(spark, side=14, seed=2):
    rng = np.random.default_rng(seed)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(side), np.arange(side), indexing="ij"))
    z = np.stack([np.sin(2 * np.pi * x / side), np.cos(2 * np.pi * y / side)], 1) * 1.4
    w = np.zeros((15, 2))
    w[:6, 0] = rng.choice([-1, 1], 6) * rng.uniform(0.8, 1.5, 6)
    w[4:11, 1] = rng.choice([-1, 1], 7) * rng.uniform(0.8, 1.5, 7)
    values = 2 + z @ w.T + 0.5 * rng.normal(size=(side * side, 15))
    cells = [(int(i), 0) for i in range(side * side)]
    edges = [(int(i), int(i + 1), 1.0) for i in range(side * side) if (i + 1) % side] + [(int(i), int(i + side), 1.0) for i in range(side * (side - 1))]
    matrix = spectrum.links(spark.createDataFrame(cells, "cell long, section int"), spark.createDataFrame(edges, "a long, b long, weight double"))
    long = [(i, f"f{d:02d}", float(values[i, d])) for i in range(side * side) for d in range(15)]
    return z, w, matrix, spark.createDataFrame(long, "cell long, feature string, value double")


def test_planted_factors_are_found_and_others_pruned(spark):
    z, w, matrix, values = planted(spark)
    got = factors.fit(matrix, values, 4, 0.5, 18, tol=0.0)
    gains = np.diff(got.bounds)
    assert len(gains) >= 10 and gains.min() > -1e-6 * abs(got.bounds[-1])
    active = got.active(0.01)
    rows = {r["cell"]: [r[f"z{k}"] for k in active] for r in got.means.collect()}
    found = np.array([rows[i] for i in range(len(z))])
    centred = z - z.mean(0)
    fitted = found @ np.linalg.lstsq(found, centred, rcond=None)[0]
    assert 1 - ((centred - fitted) ** 2).sum() / (centred**2).sum() > 0.9
    assert got.explained.sum() > 0.5 and len(active) < 4
    noise = got.weights.noise()
    assert 2 < np.median(noise) < 6  # the truth is 4


def test_bound_of_updates_alone_never_falls():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(200, 3))
    y = z[:, :2] @ rng.normal(size=(2, 9)) + 0.3 * rng.normal(size=(200, 9))
    y -= y.mean(0)
    square, gram, b = (y**2).sum(0), z.T @ z + 0.1 * np.eye(3), y.T @ z
    w = factors.first_weights(square, 200, 3, 1)
    last = -np.inf
    for _ in range(40):
        w = factors.update(w, square, b, gram, 200)
        now = factors.bound(w, square, b, gram, 200, 10.0, 0.0, 0.0)
        assert now >= last - 1e-8 * abs(now)
        last = now
    assert w.gamma[:, 2].mean() < 0.5 < w.gamma[:, :2].mean()


def test_no_values(spark):
    _, _, matrix, values = planted(spark, 3)
    got = factors.fit(matrix, values.filter("cell < 0"), 2, 1.0, 3)
    assert got.features == [] and got.bounds == [] and got.means.count() == 9


def test_a_round_multiplies_by_the_matrix_once(spark, monkeypatch):
    _, _, matrix, values = planted(spark, 6)
    calls, plain = [], spectrum.product
    monkeypatch.setattr(spectrum, "product", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = factors.fit(matrix, values, 2, 0.5, 2, tol=0.0)
    assert len(calls) == len(got.bounds) == 3
