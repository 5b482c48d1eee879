import numpy as np
import pytest
from pairloom.operators import domains, score


def world(spark, side=15, seed=3):
    rng = np.random.default_rng(seed)
    n = side * side
    x, y = (v.ravel() for v in np.meshgrid(np.arange(side), np.arange(side), indexing="ij"))
    truth = (x >= side // 3).astype(int) + (x >= 2 * side // 3)
    rates = np.full((3, 12), 1.0)
    for j in range(3):
        rates[j, 4 * j : 4 * j + 4] = 2.0
    depth = rng.uniform(0.6, 1.5, n)
    c = rng.poisson(rates[truth] * depth[:, None])
    edges = [(i, i + 1) for i in range(n) if (i + 1) % side] + [(i, i + side) for i in range(n - side)]
    rows = [(i, f"f{j:02d}", int(c[i, j])) for i in range(n) for j in range(12) if c[i, j]]
    return truth, spark.createDataFrame([(i,) for i in range(n)], "cell long"), spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(rows, "cell long, feature string, count long")


def agreement(spark, got, truth):
    rows = [(int(truth[r["cell"]]), r["label"]) for r in got.cells.collect()]
    return score.ari(spark.createDataFrame(rows, "a int, b int")).first()[0]


def test_bound_never_falls_and_planted_domains_are_found(spark):
    truth, cells, edges, counts = world(spark)
    got = domains.fit(cells, edges, counts, 5, 1.0, 30, tol=1e-5)
    gains = np.diff(got.bounds)
    assert len(gains) > 5 and gains.min() > -1e-7 * abs(got.bounds[-1])
    assert agreement(spark, got, truth) >= 0.9
    assert got.weights.sum() == pytest.approx(1) and (np.diff(got.weights) <= 0).all()
    for r in got.cells.collect():
        assert sum(r["phi"]) == pytest.approx(1) and r["phi"][r["label"]] == r["p"] == max(r["phi"])


def test_neighbours_help(spark):
    truth, cells, edges, counts = world(spark)
    apart = domains.fit(cells, edges.limit(0), counts, 3, 1.0, 8)
    together = domains.fit(cells, edges.union(edges), counts, 3, 1.0, 8)
    assert np.diff(apart.bounds).min() > -1e-7 * abs(apart.bounds[-1])
    assert agreement(spark, together, truth) > agreement(spark, apart, truth)


def test_sticks_and_gammas_are_stationary():
    """With phi fixed, no other sticks or rates give a higher bound."""
    mass = np.array([30.0, 8.0, 2.0])
    log_pi, own = domains._sticks(mass)
    best = mass @ log_pi + own
    for other in ([25.0, 8.0, 2.0], [30.0, 6.0, 4.0], [31.0, 8.5, 2.0]):
        log_pi, own = domains._sticks(np.array(other))
        assert mass @ log_pi + own < best
    taken, sized = 17.0, 5.0
    def bound(a, b):
        mean, log, own = domains._gammas(np.array([a]), np.array([b]))
        return taken * log[0] - sized * mean[0] + own
    best = bound(domains.A + taken, domains.B + sized)
    assert all(bound(domains.A + taken + x, domains.B + sized + y) < best for x, y in ((1, 0), (0, 0.5), (-1, -0.2)))


def test_odd_tables(spark):
    _, cells, edges, counts = world(spark, 4)
    assert domains.fit(cells.limit(0), edges, counts, 3).cells.count() == 0
    flat = domains.fit(cells, edges, counts.limit(0), 3)
    assert flat.bounds == [] and {r["label"] for r in flat.cells.collect()} == {0}
    nulls = spark.createDataFrame([(None, "f00", 2), (3, None, 4), (4, "f00", None), (99, "f01", 3)], "cell long, feature string, count long")
    got = domains.fit(cells.selectExpr("*", "1 AS s", "2 AS d"), edges.union(spark.createDataFrame([(1, 1), (1, 99)], "a long, b long")), counts.union(nulls).withColumn("p0", counts.cell), 2, rounds=3)
    assert got.cells.count() == 16
    assert domains.fit(cells, edges, counts, 1, rounds=2).rates.shape == (1, 12)
