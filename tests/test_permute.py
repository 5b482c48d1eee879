import numpy as np
import pytest
from pairloom.operators import lra, permute


def world(spark):
    rng = np.random.default_rng(3)
    cells = [(100 + i, i % 2) for i in range(40)]
    edges = [(100 + i, 102 + i) for i in range(38)] + [(100, 101)]  # the last lies across sections
    x = rng.poisson(1.5, (40, 5)).astype(float)
    x[:, 0] = np.arange(40) // 2
    x[:, 1] = (np.arange(40) // 10) % 2 + rng.normal(0, 0.8, 40)
    x[:, 4] = 3.0
    rows = [(100 + i, f"f{j}", float(x[i, j])) for i in range(40) for j in range(5)]
    return cells, edges, x, spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(cells, "cell long, section int"), spark.createDataFrame(rows, "cell long, feature string, count double")


def plain(cells, edges, x, perms, seed):
    """Moran's I of the observed order and of each shuffle."""
    section = np.array([s for _, s in cells])
    inside = [(a - 100, b - 100) for a, b in edges if section[a - 100] == section[b - 100]]
    out = []
    for k in range(perms + 1):
        v = x.copy()
        for s in (0, 1):
            own = np.flatnonzero(section == s)
            if k:
                v[own] = x[own][np.random.default_rng([seed, s, k]).permutation(len(own))]
        z = v - v.mean(0)
        out.append(len(x) / (2 * len(inside)) * sum(2 * z[a] * z[b] for a, b in inside) / np.where((z**2).sum(0) > 1e-12, (z**2).sum(0), np.nan))
    return np.array(out)


@pytest.mark.parametrize("numbers", [1 << 23, 60])
def test_verdicts_are_those_of_all_shuffles(spark, monkeypatch, numbers):
    monkeypatch.setattr(permute, "NUMBERS", numbers)
    cells, edges, x, e, c, v = world(spark)
    perms = 200
    all_ = plain(cells, edges, x, perms, 7)
    got = {r["feature"]: r for r in permute.curtailed_moran(e, c, v, perms, 7, steps=(20, 40, 140)).collect()}
    assert len(got) == 5
    for j in range(4):
        r = got[f"f{j}"]
        assert r["moran"] == pytest.approx(all_[0, j])
        above = (all_[1 : r["shuffles"] + 1, j] >= all_[0, j] - 1e-9 * abs(all_[0, j]) - 1e-12).sum()
        assert r["above"] == above and r["p"] == pytest.approx((1 + above) / (1 + r["shuffles"]))
        full = (1 + (all_[1:, j] >= all_[0, j] - 1e-12).sum()) / (1 + perms)
        assert r["rejected"] == (full <= 0.05)
    assert got["f0"]["rejected"] and got["f0"]["shuffles"] == perms and min(got[f"f{j}"]["shuffles"] for j in (2, 3)) < perms
    assert np.isnan(got["f4"]["moran"]) and got["f4"]["shuffles"] == 0 and not got["f4"]["rejected"]


def test_no_contacts(spark):
    _, _, _, e, c, v = world(spark)
    got = permute.curtailed_moran(e.limit(0), c, v, 20).collect()
    assert len(got) == 5 and all(np.isnan(r["moran"]) and r["shuffles"] == 0 for r in got)


def test_ranges_of_shuffles_and_blocks_of_features_draw_one_stream(spark, monkeypatch):
    cells, edges, x, e, c, v = world(spark)
    want = {r["feature"]: r for r in lra.permuted_moran(e, c, v, 60, 9).collect()}
    for name, value in (("NUMBERS", 60), ("PIECE", 21), ("ENDS", 6), ("WORK", 1)):
        monkeypatch.setattr(permute, name, value)
    monkeypatch.setattr(lra, "DRAWN", 7)
    p = permute.placed(e, c, v)
    assert p.tasks == 4 and p.links == 38 and p.pieces.filter("block < 0").count() > 2 and p.pieces.filter("block >= 0").count() > 8
    sums = permute.shuffled_sums(p, permute.streamed(9), 0, 61, 7)
    assert sums.count() == 61 * 5
    got = {r["feature"]: r for r in lra.permuted_moran(e, c, v, 60, 9).collect()}
    section = np.array([s for _, s in cells])
    rngs, above = [np.random.default_rng([9, s]) for s in (0, 1)], np.zeros(5)
    z = x - x.mean(0)
    inside = np.array([(a - 100, b - 100) for a, b in edges if section[a - 100] == section[b - 100]])
    seen = (z[inside[:, 0]] * z[inside[:, 1]]).sum(0)
    for _ in range(60):
        moved = z.copy()
        for s in (0, 1):
            own = np.flatnonzero(section == s)
            moved[own] = z[own][rngs[s].permutation(len(own))]
        above += (moved[inside[:, 0]] * moved[inside[:, 1]]).sum(0) >= seen - 1e-9
    for j in range(4):
        assert got[f"f{j}"]["p"] == pytest.approx((1 + above[j]) / 61) == pytest.approx(want[f"f{j}"]["p"])
        for name in ("moran", "null_mean", "null_sd"):
            assert got[f"f{j}"][name] == pytest.approx(want[f"f{j}"][name], rel=1e-9)
    assert np.isnan(got["f4"]["p"]) and np.isnan(want["f4"]["p"])


@pytest.mark.parametrize("top, kind", [(255, "u1"), (330, "u2"), (65535, "u2"), (0.5, "f8")])
def test_products_are_exact(top, kind):
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 2, (500, 32)) * top).astype(kind)
    a, b = rng.integers(0, 500, (2, 9001)).astype(np.int32)
    assert permute._products(v, a, b, float(top)).tolist() == (v[a].astype(float) * v[b]).sum(0).tolist()
