import numpy as np
import pytest
from pairloom.operators import effect


def plain(t, x, fold, y, penalty=1.0):
    x = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)])
    e, m = np.full(len(y), np.nan), np.full((2, len(y)), np.nan)
    for f in np.unique(fold):
        out, fit = fold == f, fold != f
        if len(np.unique(t[fit])) == 2:
            e[out] = 1 / (1 + np.exp(-x[out] @ effect.logistic(x[fit], t[fit].astype(float), penalty)))
        for arm in (0, 1):
            own = fit & (t == arm)
            if own.any():
                m[arm, out] = x[out] @ effect.ridge(x[own].T @ x[own], x[own].T @ y[own], penalty)
    return e, m


def test_fits_by_sums_are_those_of_gathered_rows(spark):
    rng = np.random.default_rng(6)
    n, rows, want = 400, [], {}
    for pair in ("u", "v", "lone", "steep"):
        x = np.column_stack([rng.normal(50, 20, n), np.full(n, 3.0), rng.normal(size=n)])
        fold = rng.integers(0, 4, n)
        t = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 50) / 20))).astype(int)
        t = {"lone": np.where(fold == 2, t, 0), "steep": (x[:, 0] > 50).astype(int)}.get(pair, t)
        y = x[:, 2] + t + rng.normal(size=n)
        want[pair] = plain(t, x, fold, y)
        rows += [(pair, i, int(fold[i]), int(t[i]), float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "pair string, cell long, fold int, treated int, y double, c1 double, c2 double, c3 double").repartition(5)
    out = effect.cross_fit(df, ["c1", "c2", "c3"])
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # no pair's rows in one task
    got = {(r["pair"], r["cell"]): (r["e"], r["m0"], r["m1"]) for r in out.collect()}
    assert len(got) == 4 * n
    for pair, (e, m) in want.items():
        assert np.array([got[pair, i] for i in range(n)]).T == pytest.approx(np.stack([e, *m]), abs=1e-7, nan_ok=True)
    assert np.isnan(want["lone"][0]).any()
    assert effect.cross_fit(df.limit(0), ["c1", "c2", "c3"]).count() == 0
