import numpy as np
from pairloom.llm import mixing, sharding, vectors
from pyspark.sql import functions as F


def test_targets_are_filled_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 50), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # weights 3, 1, 2, 3 share 300; b stops at 20, null at 80; 200 is shared 3 : 2, c stops at 100, a takes 100
    assert abs(sum(got.values()) - 300) < 1e-9 and got["b"] == 20 and got[None] == 80
    assert abs(got["a"] - 120) < 1e-9 and abs(got["c"] - 80) < 1e-9


def mixed(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", ["a", "b", "c", None][min(3, int(rng.integers(0, 9)) // 2)], 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_is_balanced_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 60)
    df = mixed(spark, 900)
    one = mixing.decide(df).collect()
    key = lambda rows: sorted((r["doc_id"], r["copies"]) for r in rows)
    assert key(one) == key(mixing.decide(df.repartition(7)).collect())
    by = {}
    for r in one:
        t = by.setdefault(r["source"], [0, r["target"], 0])
        t[0] += r["size"] * r["copies"] * r["n"]
        assert r["copies"] in (0, 1, 2)
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 60
    assert abs(sum(t[1] for t in by.values()) - 1.5 * sum(r["size"] * r["n"] for r in one)) < 1e-6


def test_mix_keeps_columns_and_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x", "s", 0), (None, "a b", "x", None, 0), (2, "a b c", "x", "s", 0), (2, "a b c", "x", "s", 0)], "doc_id long, text string, size string, source string, copies int")
    out = mixing.mix(df)
    assert out.columns == df.columns
    rows = mixing.decide(df).collect()
    assert sum(r["n"] for r in rows) == 4
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(4)
    n, mean = 40, np.zeros(40)
    t = rng.integers(1, 50, n).astype(float)
    for k in range(300):
        p = [0.3] * n
        mixing.flight(p, [1.0] * n, t.tolist(), np.random.default_rng(k), 2)
        assert abs(sum(p) - 0.3 * n) < 1e-6 and abs(np.dot(p, t) - 0.3 * t.sum()) < 1e-5
        assert sum(0 < x < 1 for x in p) <= 2
        mean += p
    assert np.abs(mean / 300 - 0.3).max() < 0.12


def test_sharding_is_even_and_keeps_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"text {rng.integers(0, 260)}" if i % 2 else f"own {i}") for i in range(3000)]
    rows += [(5000 + i, "hot") for i in range(1500)] + [(None, None), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    out = sharding.assign(df).toPandas()
    assert len(out) == len(rows)
    n = out.groupby("shard").size()
    assert len(n) == 8 and n.max() - n.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    groups = out[out["size"] != 4].groupby(["text_crc32", "size"]).shard.nunique()
    assert (groups > 1).sum() <= 8  # hash shards alone would split nearly all of 260 groups
    again = sharding.assign(df.repartition(5)).toPandas()
    cols = ["doc_id", "text_crc32", "shard", "slot"]
    assert out[cols].sort_values(cols).values.tolist().__repr__() == again[cols].sort_values(cols).values.tolist().__repr__()
    assert sharding.assign(df.limit(0)).count() == 0


def exact(x, label, threshold=vectors.COSINE):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    return link


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 25)  # groups dealt to several tasks
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 64))
    x = np.concatenate([c + rng.normal(size=(k, 64)) * s for c, k, s in zip(centre, [1] * 15 + [4] * 10 + [60] * 5, [0.05, 0.1, 0.16] * 10, strict=True)]).astype(np.float32)
    x = np.concatenate([x, x[:10], x[100:103] * 3])
    label = rng.integers(0, 2, len(x))
    rows = [(int(i), [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, label, strict=True))]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 1), (9004, [float("nan")] * 64, 1), (9005, [float("inf")] + [1.0] * 63, 1), (9006, [None, 1.0], 0), (9007, rows[0][1], None), (9008, [1.0, 2.0], 0), (9009, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    link = exact(x.astype(np.float64), label)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= link.sum() and found >= 0.99 * link.sum()
    root = vectors._forest(link)
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.99
    for i in range(9001, 9008):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[9009]["n_links"] == 1 and got[9009]["component_id"] == 9008 and not got[9009]["kept"]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_no_pair_below_the_cosine(spark):
    a = np.zeros(64)
    a[0] = 1
    b = a.copy()
    b[1] = np.tan(np.arccos(0.9799))
    df = spark.createDataFrame([(1, a.tolist(), 0), (2, b.tolist(), 0)], "vec_id long, embedding array<double>, label int")
    assert vectors.near_duplicates(df).agg(F.sum("n_links")).first()[0] == 0


def test_lists_grow_with_the_vectors():
    rng = np.random.default_rng(1)
    x, o = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o -= (o * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    assert vectors.listed(64) == vectors.listed(1 << 14) == 24 < vectors.listed(1 << 15)
    for rows in (1 << 20, 1 << 23):
        missed = sum(not len(np.intersect1d(i, j)) for k in range(0, 3000, 500) for i, j in zip(vectors.decode(x[k : k + 500], rows), vectors.decode(y[k : k + 500], rows), strict=True))
        assert missed < 3
