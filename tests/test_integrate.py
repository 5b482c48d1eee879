import numpy as np
import pytest
from pairloom.operators import integrate


def test_components_equal_dense_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(0.7, (60, 9)) * rng.uniform(0.5, 2, 9)
    x[5] = 0
    x[:, 7], x[:, 8] = 3.0, 0.0
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(60) for j in range(9) if x[i, j]]
    values = spark.createDataFrame([*rows, (0, None, 3.0), (99, "f1", 2.0)], "cell long, feature string, value double")
    cells = spark.createDataFrame([(i, i) for i in range(60)], "cell long, v int")
    got = {r["cell"]: r["embedding"] for r in integrate.components(values, cells, 4, 2.0).collect()}
    z = np.minimum((x[:, :7] - x[:, :7].mean(0)) / x[:, :7].std(0, ddof=1), 2.0)
    z -= z.mean(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = u[:, :4] * s[:4]
    found = np.array([got[i] for i in range(60)])
    np.testing.assert_allclose(np.abs((found * want).sum(0)), (want**2).sum(0), rtol=1e-8)
    assert len(got) == 60 and integrate.components(values.limit(0), cells, 2).filter("embedding[0] = 0").count() == 60


def test_offsets_equal_a_dense_ridge():
    rng = np.random.default_rng(1)
    r, z, which = rng.dirichlet(np.ones(3), 50), rng.normal(size=(50, 4)), rng.integers(0, 2, 50)
    hot = np.eye(2)[which]
    o, s = np.einsum("ik,ib->kb", r, hot), np.einsum("ik,ib,id->kbd", r, hot, z)
    got = integrate.offsets(o, s)
    for k in range(3):
        design = np.hstack([np.ones((50, 1)), hot])
        a = design.T @ (r[:, k, None] * design) + np.diag([0, 1, 1])
        np.testing.assert_allclose(got[k], np.linalg.solve(a, design.T @ (r[:, k, None] * z))[1:], rtol=1e-9)


def neighbours(x, label, k=10):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return (label[np.argsort(d, 1)[:, :k]] == label[:, None]).mean()


def test_batches_mix_and_planted_types_stay_apart(spark):
    rng = np.random.default_rng(5)
    kind, batch = rng.integers(0, 3, 360), rng.integers(0, 2, 360)
    centres = 6 * np.eye(3, 5)
    z = centres[kind] + rng.normal(0, 0.5, (360, 5)) + batch[:, None] * np.array([0.0, 0, 0, 2.5, 1.5])
    rows = [(i, "ab"[b], [float(v) for v in row]) for i, (b, row) in enumerate(zip(batch, z, strict=True))]
    cells = spark.createDataFrame(rows, "cell long, batch string, embedding array<double>")
    got = integrate.correct(cells, 4, corrections=3, rounds=5, starts=4)
    found = {r["cell"]: r["embedding"] for r in got.cells.collect()}
    new = np.array([found[i] for i in range(360)])
    assert neighbours(z, batch) > 0.85 and neighbours(new, batch) < 0.65
    assert neighbours(new, kind) > 0.97
    assert got.objectives[-1] < got.objectives[0] and got.corrections >= 2
    again = {r["cell"]: r["embedding"] for r in integrate.correct(cells, 4, corrections=1, rounds=2, starts=2).cells.collect()}
    repeated = {r["cell"]: r["embedding"] for r in integrate.correct(cells.repartition(7), 4, corrections=1, rounds=2, starts=2).cells.collect()}
    np.testing.assert_allclose([again[i] for i in range(360)], [repeated[i] for i in range(360)], rtol=1e-7, atol=1e-9)


def test_odd_tables(spark):
    schema = "cell long, batch string, embedding array<double>, z int"
    rows = [(1, "a", [1.0, 0.0], 1), (2, "a", [0.0, 1.0], 1), (3, None, [1.0, 1.0], 1), (4, "b", None, 1), (5, "b", [None, 1.0], 1)]
    got = integrate.correct(spark.createDataFrame(rows, schema))
    assert {r["cell"]: list(r["embedding"]) for r in got.cells.collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0]} and got.objectives == []
    assert integrate.correct(spark.createDataFrame([], schema)).cells.count() == 0
    two = integrate.correct(spark.createDataFrame([*rows[:2], (6, "b", [0.0, 0.0], 1)], schema), 5, corrections=1, rounds=1, starts=1)
    assert two.cells.count() == 3


def test_single_cell_baseline_computes_sparse_components_once(spark, monkeypatch):
    from pairloom.operators import cluster, effect
    from pairloom.plans import catalog
    from pairloom.sources import views

    folder, seen = "/root/testdata/sf0.001", []
    kmeans = cluster.spherical_kmeans
    monkeypatch.setattr(effect, "gram", None)  # no row is spread to features x features rows
    monkeypatch.setattr(cluster, "spherical_kmeans", lambda v, *a: seen.append(v) or kmeans(v, *a))
    labels = catalog.QUERIES["m48_single_cell_baseline"](spark, folder).collect()
    assert not seen[0].inputFiles()  # rounds of k-means read components, not tables
    cells = sorted(r["cell"] for r in views.cells(spark, folder).collect())
    counts = views.counts(spark, folder).toPandas().pivot(index="cell", columns="feature", values="count").reindex(cells).fillna(0).to_numpy()
    x = np.log1p(counts / np.maximum(counts.sum(1, keepdims=True), 1) * 1e4)
    z = np.minimum((x - x.mean(0)) / x.std(0, ddof=1), 10)
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    got = np.array([r["embedding"] for r in seen[0].orderBy("cell").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, :5] * s[:5]), atol=1e-7)
    assert sorted(r["cell"] for r in labels) == cells
