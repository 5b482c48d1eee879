import numpy as np
import pytest
from pairloom.operators import attention


def world(spark, side=8, features=10, seed=4):
    rng = np.random.default_rng(seed)
    n = side * side
    xs, ys = (v.ravel() for v in np.meshgrid(np.arange(side), np.arange(side), indexing="ij"))
    domain = (xs >= side // 2).astype(int)
    x = rng.poisson(0.4, (n, features)) + 2.0 * (np.arange(features) % 2 == domain[:, None])
    edges = [(i, i + 1) for i in range(n) if (i + 1) % side] + [(i, i + side) for i in range(n - side)]
    cells = spark.createDataFrame([(i, float(a), float(b), 0) for i, (a, b) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True))], "cell long, x double, y double, section int")
    rows = [(i, f"f{j:02d}", float(x[i, j])) for i in range(n) for j in range(features) if x[i, j]]
    return x, domain, edges, cells, spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(rows, "cell long, feature string, value double")


def whole(x, edges):
    n = len(x)
    both = sorted({(b, a) for a, b in edges} | {(a, b) for a, b in edges} | {(i, i) for i in range(n)})
    return np.array([s for _, s in both]), np.array([d for d, _ in both])


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 5))
    src, dst = whole(x, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (0, 4)])
    p = attention.start(5, 4, 3, 2)
    own = np.array([0, 2, 3, 6])
    loss, grads = attention.loss_and_gradient(p, x, src, dst, own)
    grads = {"w1": grads["w1"] + grads["w1d"], "w2": grads["w2"] + grads["w2d"], "s": grads["s"], "t": grads["t"]}
    for k, g in grads.items():
        for at in np.ndindex(g.shape):
            ends = []
            for h in (1e-6, -1e-6):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += h
                ends.append(attention.loss_and_gradient(q, x, src, dst, own)[0])
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[at], rel=1e-5, abs=1e-5)
    assert loss > 0


@pytest.mark.parametrize("most", [7, 100])
def test_blocks_give_the_gradient_of_the_whole_graph(spark, most):
    x, _, edges, cells, e, v = world(spark)
    blocks = attention.packed(cells, e, v, {f"f{j:02d}": j for j in range(10)}, most)
    assert (blocks.count() > 8) == (most == 7)
    p = attention.start(10, 6, 3, 5)
    src, dst = whole(x, edges)
    loss, grads = attention.loss_and_gradient(p, x, src, dst, np.arange(len(x)))
    got, sums = attention.gradient(blocks, p)
    assert got == pytest.approx(loss, rel=1e-10)
    for k, g in grads.items():
        np.testing.assert_allclose(sums[k], g, rtol=1e-8, atol=1e-8)
    z = {r["cell"]: r["z"] for r in attention.embed(blocks, p).collect()}
    np.testing.assert_allclose([z[i] for i in range(len(x))], attention.encode(p, x, src, dst)["z"], rtol=1e-9, atol=1e-12)


def test_training_lowers_the_error_and_separates_planted_domains(spark):
    x, domain, _, cells, e, v = world(spark)
    got = attention.fit(cells, e, v, 8, 2, 40, rate=0.02, most=40)
    assert got.losses[-1] < 0.6 * got.losses[0]
    z = {r["cell"]: r["z"] for r in got.embedding.collect()}
    z = np.array([z[i] for i in range(len(x))])
    centres = np.array([z[domain == k].mean(0) for k in (0, 1)])
    assert ((((z[:, None] - centres) ** 2).sum(2).argmin(1)) == domain).mean() > 0.9
    again = attention.fit(cells, e.union(e), v, 8, 2, 3, rate=0.02, most=40)
    np.testing.assert_allclose(again.losses, got.losses[:4], rtol=1e-9)


def test_odd_tables(spark):
    _, _, _, cells, e, v = world(spark, 3)
    assert attention.fit(cells.limit(0), e, v, 4, 2, 2).losses == []
    assert attention.fit(cells, e, v.limit(0), 4, 2, 2).embedding.count() == 0
    alone = attention.fit(cells, e.limit(0), v.filter("cell <> 4").withColumn("block", v.cell).withColumn("own", v.cell), 4, 2, 2)
    assert len(alone.losses) == 3 and alone.embedding.count() == 9
