import numpy as np
import pytest
from pairloom.operators import spectrum as S
from pyspark.sql import functions as F


def grid(side, section, first=0):
    at = lambda i, j: first + i * side + j
    cells = [(at(i, j), section) for i in range(side) for j in range(side)]
    edges = [(at(i, j), at(i + 1, j), 1.0 + 0.5 * (j % 2)) for i in range(side - 1) for j in range(side)]
    edges += [(at(i, j), at(i, j + 1), 1.0) for i in range(side) for j in range(side - 1)]
    return cells, edges


def dense(cells, edges):
    at = {c: i for i, (c, _) in enumerate(cells)}
    out = np.zeros((len(at), len(at)))
    for a, b, w in edges:
        i, j = at[a], at[b]
        out[i, j] -= w
        out[j, i] -= w
        out[i, i] += w
        out[j, j] += w
    return out


@pytest.fixture(scope="module")
def two(spark):
    (c1, e1), (c2, e2) = grid(20, 1), grid(4, 2, 1000)
    c2.append((2000, 2))  # alone
    e2.append((1000, 1000, 5.0))  # a loop counts for nothing
    matrix = S.links(spark.createDataFrame(c1 + c2, "cell long, section int"), spark.createDataFrame(e1 + e2, "a long, b long, weight double"))
    return matrix.cache(), {1: dense(c1, e1), 2: dense(c2, e2[:-1])}


def test_quadrature_is_near_the_dense_spectrum(two):
    matrix, want = two
    nodes = S.spectrum(matrix, small=50, probes=16, steps=14).cache()
    assert {r["section"]: r["exact"] for r in nodes.select("section", "exact").distinct().collect()} == {1: False, 2: True}
    for rho in (0.1, 1.0, 10.0):
        for r in S.traces(nodes, rho).collect():
            lam = np.linalg.eigvalsh(want[r["section"]])
            exact = r["section"] == 2
            # a large rho weighs the few smallest eigenvalues, which 16 probes meet by chance
            near = {"rel": 1e-9 if exact else 0.01 if rho <= 1 else 0.04}
            assert r["n"] == pytest.approx(len(lam))
            assert r["log_det"] == pytest.approx(np.log1p(rho * lam).sum(), **near)
            assert r["inverse"] == pytest.approx((1 / (1 + rho * lam)).sum(), **near)
            assert r["total"] == pytest.approx(lam.sum(), **near)
            assert r["slope"] == pytest.approx(-rho * (lam / (1 + rho * lam) ** 2).sum() / (1 / (1 + rho * lam)).sum(), **({"rel": 1e-9} if exact else {"rel": 0.05}))


def test_recurrence_that_ends_early_is_exact(two):
    matrix, want = two
    small = matrix.filter("section = 2")
    nodes = S.lanczos(small, 3, 20)
    # the quadrature of each probe is exact; probes differ by the trace estimate alone, and tr L of a +-1 probe by off-diagonals
    assert nodes.agg(F.sum("weight")).first()[0] == pytest.approx(17)
    assert 0 <= nodes.agg(F.min("theta")).first()[0] and nodes.agg(F.max("theta")).first()[0] <= np.linalg.eigvalsh(want[2]).max() + 1e-6
    again = S.lanczos(small.repartition(7), 3, 20)
    # the last steps before a recurrence ends magnify rounding, which depends on the order of sums; traces don't
    for rho in (0.3, 3.0):
        one, two_ = (S.traces(x, rho).first() for x in (nodes, again))
        assert tuple(one)[1:] == pytest.approx(tuple(two_)[1:], rel=1e-6)


def test_systems_are_solved(spark, two):
    matrix, want = two
    rng = np.random.default_rng(5)
    cells = [r[0] for r in matrix.filter("src = dst").select("src").orderBy("src").collect()]
    b = {c: (float(rng.normal()), float(rng.normal()) if c < 1000 else 0.0) for c in cells}
    rows = [(c, *v) for c, v in b.items() if c != 2000]  # a missing cell counts as 0
    x, steps = S.solve(matrix, spark.createDataFrame(rows, "cell long, one double, two double"), ["one", "two"], 0.7, 0.3, tol=1e-7)
    got = {r["cell"]: (r["one"], r["two"]) for r in x.collect()}
    for own, lap in (([c for c in cells if c < 1000], want[1]), ([c for c in cells if c >= 1000], want[2])):
        right = np.array([b[c] if c != 2000 else (0, 0) for c in own])
        assert np.allclose([got[c] for c in own], np.linalg.solve(0.7 * np.eye(len(own)) + 0.3 * lap, right), atol=1e-5)
    assert 0 < steps < 60


def test_no_cells(spark):
    matrix = S.links(spark.createDataFrame([], "cell long, section int"), spark.createDataFrame([], "a long, b long, weight double"))
    assert S.spectrum(matrix).count() == 0 and S.lanczos(matrix, 2, 3).count() == 0


def test_moments_form_no_dense_matrix(spark, monkeypatch):
    cells = spark.createDataFrame([(0, i) for i in range(40)], "section int, cell long")
    edges = spark.createDataFrame([(i, i + 1, 1.0 + i) for i in range(39)], "a long, b long, weight double")
    matrix = S.links(cells, edges)
    theta = [r["theta"] for r in S.exact(matrix).collect()]
    monkeypatch.setattr(S, "exact", None)
    got = S.moments(matrix).first()
    assert got["n"] == 40 and abs(got["first"] - sum(theta)) < 1e-8 and abs(got["second"] - sum(t * t for t in theta)) < 1e-6


def test_steps_in_one_group_give_the_nodes_of_steps_by_joins(two):
    matrix, _ = two
    names = ["n", "log_det", "inverse", "slope", "total"]
    one, many = ({r["section"]: r for r in S.traces(S.spectrum(matrix, small=0, probes=4, steps=9, whole=w), 1.0).collect()} for w in (S.WHOLE, 0))
    assert one.keys() == many.keys() and len(one) > 0
    for s in one:
        assert [one[s][c] for c in names] == pytest.approx([many[s][c] for c in names], rel=1e-8)


def test_systems_solved_in_one_group_are_those_solved_by_joins(spark, two):
    matrix, _ = two
    rng = np.random.default_rng(8)
    rows = [(r[0], float(rng.normal()), 0.0, float(rng.poisson(2))) for r in matrix.filter("src = dst AND src % 9 <> 0").select("src").collect()]
    right = spark.createDataFrame(rows, "cell long, one double, two double, three double")
    names = ["one", "two", "three"]
    sizes = sorted(r["count"] for r in matrix.groupBy("section").count().collect())
    got = []
    for whole in (0, sizes[0], S.WHOLE):  # by joins, one section of two by joins, both in one group
        x, steps = S.solve(matrix, right, names, 1.0, 2.0, tol=1e-7, whole=whole)
        got.append(({r["cell"]: [r["section"], *[r[c] for c in names]] for r in x.collect()}, steps))
    assert got[0][0].keys() == got[1][0].keys() == got[2][0].keys()
    for x, steps in got[1:]:
        assert steps == got[0][1] and all(x[c] == pytest.approx(got[0][0][c], abs=1e-10) for c in x)
    with pytest.raises(ValueError, match="did not reach"):
        S.solve(matrix, right, names, 1.0, 2.0, tol=1e-7, most=2)
