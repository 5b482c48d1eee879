import zlib

import numpy as np
import pytest
from pairloom.operators import coexpression as X
from pairloom.operators.numeric import digamma


def world(spark, seed=8):
    """Two batches, eight bins; f0 and f1 rise together over bins, the others don't."""
    rng = np.random.default_rng(seed)
    cells, counts, shares = [], [], []
    for i in range(320):
        batch, code = "ab"[i % 2], int(rng.integers(32))
        cells.append((i, batch, code))
        s = float(rng.choice([0.25, 0.5, 1.0]))
        shares.append((i, 0, s))
        if s < 1:
            shares.append((i, 1, 1 - s))
        level = 1 + 3 * ((code * 7 + (i % 2)) % 5)
        for j in range(5):
            c = rng.poisson(level if j < 2 else 3)
            if c:
                counts.append((i, f"f{j}", float(c)))
    pairs = [("f0", "f1"), ("f1", "f0"), ("f2", "f3"), ("f3", "f4"), ("f0", "f4"), ("f2", "none")]
    return cells, counts, shares, pairs


def frames(spark, cells, counts, shares, pairs):
    return spark.createDataFrame(counts, "cell long, feature string, count double"), spark.createDataFrame(shares, "cell long, community long, share double"), spark.createDataFrame(cells, "cell long, batch string, bin int"), spark.createDataFrame(pairs, "ligand string, receptor string")


def plain(cells, counts, shares, pairs, stratum, community, batches, perms, seed, buckets):
    """The stratum's statistics, sample by sample and shuffle by shuffle."""
    place = {c: (b, k) for c, b, k in cells if b in batches}
    samples = sorted(set(place.values()))
    at = {s: i for i, s in enumerate(samples)}
    share = {c: s for c, g, s in shares if g == community and c in place}
    weight = np.zeros(len(samples))
    for c, s in share.items():
        weight[at[place[c]]] += s
    num = {f"f{j}": np.zeros(len(samples)) for j in range(5)}
    for c, f, n in counts:
        if c in share:
            num[f][at[place[c]]] += share[c] * n
    key = zlib.crc32(stratum.encode())
    groups = {}
    for i, (b, k) in enumerate(samples):
        groups.setdefault(buckets[b, k & 15], []).append(i)
    out = []
    for k in range(perms + 1):
        order = np.arange(len(samples))
        if k:
            u = np.random.default_rng([seed, key, k]).random(len(samples))
            for members in groups.values():
                order[members] = sorted(members, key=lambda i: u[i])
            logs = {f: np.log(np.random.default_rng([seed, key, k, zlib.crc32(f.encode())]).standard_gamma(1 + v)) - np.log(1 + weight) for f, v in num.items()}
        else:
            logs = {f: np.array([digamma(1 + x) for x in v]) - np.log(1 + weight) for f, v in num.items()}
        row = []
        for a, b in pairs:
            x, y = logs[a][order], logs[b]
            row.append(np.average((x - np.average(x, weights=weight)) * (y - np.average(y, weights=weight)), weights=weight))
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("numbers", [1 << 21, 150])
def test_equals_plain_shuffles_and_minima(spark, monkeypatch, numbers):
    monkeypatch.setattr(X, "NUMBERS", numbers)
    cells, counts, shares, pairs = world(spark)
    perms, seed = 150, 5
    got = {(r["community"], r["batch"], r["ligand"], r["receptor"]): r for r in X.permutation_test(*frames(spark, cells, counts, shares, pairs), perms, seed).collect()}
    real = pairs[:5]
    assert len(got) == 6 * len(real)  # two communities, each in two batches and in both
    keys = spark.createDataFrame([(b, k) for b in "ab" for k in range(16)], "of string, bin int").selectExpr("of", "bin", "xxhash64(of, bin) AS h").collect()
    buckets = {(r["of"], r["bin"]): r["h"] for r in keys}
    for community, batch in ((0, ""), (1, "a")):
        stratum = f"one:{community}:{batch}" if batch else f"all:{community}:"
        t = plain(cells, counts, shares, real, stratum, community, batch or "ab", perms, seed, buckets)
        ranks = np.argsort(np.argsort(-t[1:], axis=0), axis=0) + 1
        minima = ranks.min(1) / perms
        for i, (a, b) in enumerate(real):
            r = got[community, batch, a, b]
            null = t[1:, i]
            assert r["stat"] == pytest.approx(t[0, i], rel=1e-9) and r["pooled"] == (batch == "")
            assert r["null_mean"] == pytest.approx(null.mean(), rel=1e-8, abs=1e-12) and r["null_sd"] == pytest.approx(null.std(ddof=1), rel=1e-8)
            assert r["p"] == pytest.approx(((null > t[0, i]).sum() + 0.5) / (perms + 1))
            own = ((null >= t[0, i]).sum() + 1) / (perms + 1)
            assert r["fwer"] == pytest.approx(((minima <= own).sum() + 1) / (perms + 1))
        middle = np.sort(t[0])[len(real) // 2]
        mad = np.sort(np.abs(t[0] - middle))[len(real) // 2]
        assert got[community, batch, *real[0]]["z_re"] == pytest.approx((t[0, 0] - middle) / (1.4826 * mad), rel=1e-8)
    planted = got[0, "", "f0", "f1"]
    assert planted["p"] < 0.02 and planted["p_z"] < 0.02 and planted["fwer"] < 0.1
    assert got[0, "", "f2", "f3"]["p"] > 0.02


def test_weights_scale_and_blocks_do_not_matter(spark):
    cells, counts, shares, pairs = world(spark)
    c, s, k, p = frames(spark, cells, counts, shares, pairs)
    w = spark.createDataFrame([("f0", 0.5)], "feature string, weight double")
    plain_, scaled = ({(r["community"], r["batch"], r["ligand"], r["receptor"]): r for r in X.permutation_test(c, s, k, p, 30, 1, x).collect()} for x in (None, w))
    for key, r in plain_.items():
        assert scaled[key]["stat"] == pytest.approx(r["stat"] * (0.5 if "f0" in key else 1)) and scaled[key]["p"] == r["p"]


def test_shuffles_stay_in_their_bucket():
    bucket = np.array([3, 1, 3, 2, 1, 3])
    for k in range(20):
        order = X._order(bucket, [1, k])
        assert sorted(order) == list(range(6)) and (bucket[order] == bucket).all()


def test_odd_tables(spark):
    c, s, k, p = frames(spark, *world(spark))
    assert X.permutation_test(c.limit(0), s, k, p, 5).count() == 0
    assert X.permutation_test(c, s.limit(0), k, p, 5).count() == 0
    assert X.permutation_test(c, s, k.filter("bin < 3 AND batch = 'a'"), p, 5).count() == 0  # three samples
    one = X.permutation_test(c.selectExpr("*", "1 AS share", "2 AS batch"), s, k.filter("batch = 'a'"), p, 5)
    assert {r["pooled"] for r in one.collect()} == {False}


def test_bins(spark):
    import hashlib

    rows = [(1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5), (3, 1, 1.0)]
    shares = spark.createDataFrame(rows, "cell long, community long, share double")
    cells = spark.createDataFrame([(i, "x") for i in range(1, 5)], "cell long, batch string")
    want = dict.fromkeys(range(1, 5), 0)
    for bit in range(6):
        v = dict.fromkeys(range(1, 5), 0.0)
        for cell, community, share in rows:
            v[cell] += share * (2 * int(hashlib.md5(f"9:{community}:{bit}".encode()).hexdigest()[:8], 16) / 2**32 - 1)
        for cell in v:
            want[cell] |= (v[cell] > sum(v.values()) / 4) << bit
    assert {r["cell"]: r["bin"] for r in X.bins(shares, cells, 6, 9).collect()} == want and len(set(want.values())) > 2
    assert X.bins(shares.limit(0), cells).collect()[0]["bin"] == 0
