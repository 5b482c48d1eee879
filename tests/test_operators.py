import math
import time

import numpy as np
import pandas as pd
import pytest
from pairloom.functions import expr as E
from pairloom.operators import cluster, effect, graph, latent, lra, pool, score, stats
from pyspark.sql import functions as F


def cells(spark, n=60, seed=0, sections=2):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(0, 30)), float(rng.integers(0, 30)), i % sections) for i in range(n)]
    return spark.createDataFrame(rows, "cell long, x double, y double, section int"), rows


def brute_knn(rows, k):
    out = set()
    for c, x, y, s in rows:
        near = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), d) for d, u, v, t in rows if t == s and d != c)[:k]
        out |= {(c, d) for _, d in near}
    return out


def test_knn_of_many_copies_meets_each_place_once(spark):
    rng = np.random.default_rng(3)
    spots = [(float(x), float(y)) for x, y in rng.integers(0, 40, (300, 2))] + [(1e5, 3.0), (-0.0, 0.0), (0.0, -0.0)]
    rows = [(i + 1000 * c, x, y, 0) for c in range(8) for i, (x, y) in enumerate(spots)]
    df = spark.createDataFrame(rows, "cell long, x double, y double, section int")
    odd = spark.createDataFrame([(-1, None, 1.0, 0), (-2, float("nan"), 1.0, 0), (-3, float("inf"), 1.0, 0)], df.schema)
    got = [(r.a, r.b, r.rank) for r in graph.knn(df.unionByName(odd), 4, 5).collect()]
    want = [(c, d, i + 1) for c, x, y, _ in rows for i, (_, d) in enumerate(sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), d) for d, u, v, _ in rows if d != c)[:4])]
    assert sorted(got) == sorted(want)


def test_tiles_of_knn_hold_places_not_copies(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    inner = graph._of_tile

    def counted(most):
        each = inner(most)

        def run(t):
            seen.add(t.num_rows)
            return each(t)

        return run

    monkeypatch.setattr(graph, "_of_tile", counted)
    rows = [(i + 100 * c, float(i % 10), float(i // 10), 0) for c in range(50) for i in range(100)]
    graph.knn(spark.createDataFrame(rows, "cell long, x double, y double, section int"), 2, 5).count()
    assert 0 < seen.value <= 2 * 9 * 3 * 100


@pytest.mark.parametrize("whole", [4000, 5])
def test_knn_whole_and_by_tiles(spark, whole):
    df, rows = cells(spark, 120)
    got = graph.knn(df, 4, whole)
    assert {(r.a, r.b) for r in got.collect()} == brute_knn(rows, 4)


def test_knn_of_tiny_sections_and_equal_places(spark):
    rows = [(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 1), (3, 0.0, 0.0, 1), (4, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "cell long, x double, y double, section int")
    for whole in (4000, 1):
        assert {(r.a, r.b) for r in graph.knn(df, 5, whole).collect()} == {(a, b) for a in (2, 3, 4) for b in (2, 3, 4) if a != b}


def rook(spark, side=4):
    rows = [(i * side + j, i * side + j + 1, 1.0) for i in range(side) for j in range(side - 1)] + [(i * side + j, (i + 1) * side + j, 1.0) for i in range(side - 1) for j in range(side)]
    return spark.createDataFrame(rows, "a long, b long, distance double")


def test_neighbourhoods_of_a_grid(spark):
    e = rook(spark)
    two = {(r.src, r.dst) for r in graph.second_neighbours(e).collect()}
    assert {d for s, d in two if s == 0} == {2, 5, 8}
    v = spark.createDataFrame([(1, 2.0), (4, 4.0)], "cell long, v double")
    got = {r.src: (r.total, r.mean) for r in graph.neighbour_sum(e, v, "v").collect()}
    assert got[0] == (6.0, 3.0) and got[15] == (0.0, 0.0)
    assert graph.k_core(e, 3).count() == 0 and graph.k_core(e, 2).count() == 24
    assert graph.components(e, spark.range(20).withColumnRenamed("id", "cell")).select("component").distinct().count() == 5


def test_components_of_paths_and_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50) if i != 20], "a long, b long")
    got = {r.cell: r.component for r in graph.components(path, spark.range(51).withColumnRenamed("id", "cell")).collect()}
    assert set(got.values()) == {0, 21} and got[20] == 0 and got[50] == 21
    assert graph.components(path.limit(0), spark.range(3).withColumnRenamed("id", "cell")).count() == 3


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")


def test_partition_scores(spark):
    same = pairs(spark, [0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 9, 9])
    assert score.ari(same).first()[0] == 1.0 and abs(score.nmi(same).first()[0] - 1) < 1e-12 and abs(score.ami(same).first()[0] - 1) < 1e-9
    assert {(r.a, r.b, r.jaccard) for r in score.match(same).collect()} == {(0, 5, 1.0), (1, 3, 1.0), (2, 9, 1.0)}
    one = pairs(spark, [0] * 4, [7] * 4)
    assert score.ari(one).first()[0] == 1.0 and score.nmi(one).first()[0] == 1.0
    # a worked example: ARI of [0,0,1,1] and [0,0,1,2] is 4/7
    assert abs(score.ari(pairs(spark, [0, 0, 1, 1], [0, 0, 1, 2])).first()[0] - 4 / 7) < 1e-12


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 6), (6, 4), (1, 3)):
        g = rng.random((n, m)).round(2)
        got = sum(g[i, j] for i, j in score.assignment(g))
        k = min(n, m)
        t = g if n <= m else g.T
        assert abs(got - max(sum(t[i, p[i]] for i in range(k)) for p in permutations(range(max(n, m)), k))) < 1e-9


def test_ranking_scores(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.8), (0, 0, 0.1), (1, 1, 0.5)], "f int, truth int, score double")
    got = {r.f: r.auroc for r in score.auroc(df, ["f"]).collect()}
    assert got[0] == 0.875 and math.isnan(got[1])
    ap = {r.f: r.ap for r in score.average_precision(df, ["f"]).collect()}
    assert abs(ap[0] - (1 + 2 / 3) / 2) < 1e-12 and ap[1] == 1.0


def test_exact_tests():
    assert score.sign_test([1, 1, 1, -1, 0]) == 0.625 and score.sign_test([0, 0]) == 1
    assert score.wilcoxon([1, 2, 3, 4, 5]) == 0.0625 and math.isnan(score.wilcoxon([])) and math.isnan(score.wilcoxon([3, 0]))
    assert score.wilcoxon([1, -1, 2]) == 0.75 and score.wilcoxon([2, 2, 2]) == 0.25
    assert abs(score.wilcoxon([1, -1]) - 1) < 1e-12


def test_multiplicity(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, float("nan")])], "f int, i int, p double")
    q = {r.i: r.q for r in stats.bh(df, ["f"], "p", "q").collect()}
    assert [round(q[i], 4) for i in range(4)] == [0.02, 0.04, 0.04, 0.02] and math.isnan(q[4])
    assert abs(stats.simes(df, ["f"], "p", "p").first()["p"] - 0.02) < 1e-12
    by = {r.i: r.q for r in stats.by_adjust(df, ["f"], "p", "q").collect()}
    assert abs(by[3] - 0.02 * 25 / 12) < 1e-9 and math.isnan(by[4])


def test_quantile_rules(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0), ("b", float("nan"))], "k string, v double")
    assert {r.k: r.m for r in stats.upper_median_by(df, ["k"], "v", "m").collect()} == {"a": 3.0, "b": 7.0}
    assert stats.quantile_by(df, [], "v", 0.5, "m").first()[0] == 3.0


def test_jeffreys_guard_and_value(spark):
    df = spark.createDataFrame([(0, 1, 1, 10), (0, 5, 5, 10), (2, 4, 4, 10)], "n11 long, n_l long, n_r long, n long")
    got = [tuple(r) for r in df.select(*E.jeffreys_log_odds(*[F.col(c) for c in df.columns])).collect()]
    assert math.isnan(got[0][0]) and got[1][0] < 0
    assert abs(got[2][0] - math.log(2.5 * 4.5 / (2.5 * 2.5))) < 1e-9
    assert abs(got[2][1] - math.sqrt(2 * (3 / 2.5 + 1 / 4.5))) < 1e-9


def test_coexpression_scores_of_a_toy(spark):
    edges = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (3, 4, 1), (4, 5, 1)], "a long, b long, community int")
    counts = spark.createDataFrame([(0, "L", 2.0), (1, "R", 1.0), (2, "L", 1.0), (2, "R", 3.0), (3, "L", 1.0)], "cell long, feature string, count double")
    depth = pool.totals(counts, "cell").select("cell", F.log1p("total").alias("depth"))
    p = spark.createDataFrame([("L", "R"), ("L", "none")], "ligand string, receptor string")
    got = {(r.community, r.receptor): r for r in lra.coexpression_scores(edges, counts, p, depth).collect()}
    r = got[0, "R"]
    assert (r.n_edges, r.n_oneway, r.n_mutual, r.lig_rate, r.rec_rate) == (2, 2, 0, 0.5, 0.75)
    assert r.role_purity == 1.0 and not math.isnan(r.log_or)
    assert got[1, "R"].n_oneway == 0 and math.isnan(got[1, "R"].role_purity) and math.isnan(got[1, "none"].log_or)


def test_membership_entropy_and_ties(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "a long, b long, community int")
    c = spark.createDataFrame([(i,) for i in range(4)], "cell long")
    m = pool.membership(edges)
    assert {r.cell: r.cluster for r in pool.dominant(m, c).collect()} == {0: 1, 1: 2, 2: 1, 3: 0}
    h = {r.cell: r.entropy for r in pool.entropy(m, c).collect()}
    assert abs(h[0] - math.log(2)) < 1e-12 and h[1] == 0 and math.isnan(h[3])


def test_gibbs_matches_the_enumerated_posterior():
    """Six edges, two communities: long chains of the conditional visit labelings as their probabilities say."""
    from itertools import product

    rng = np.random.default_rng(1)
    y = rng.poisson(2.0, (6, 3)).astype(float)
    y[:3, 0] += 4
    lp = {}
    for z in product((0, 1), repeat=6):
        d = np.zeros((2, 3))
        for e, k in enumerate(z):
            d[k] += y[e]
        n = np.bincount(z, minlength=2)
        lp[z] = cluster.log_marginal(d, d.sum(1)) + sum(math.lgamma(a + cluster.ALPHA / 2) for a in n)
    top = max(lp.values())
    total = sum(math.exp(v - top) for v in lp.values())
    pair = sum(math.exp(v - top) for z, v in lp.items() if z[0] == z[1]) / total
    z, hits, cols = np.zeros(6, int), 0, np.arange(3)
    for sweep in range(4000):
        for e in range(6):
            rest = np.arange(6) != e
            d = np.stack([y[rest & (z == k)].sum(0) for k in (0, 1)])
            p = cluster.edge_log_probs(cols, y[e], d, d.sum(1), np.bincount(z[rest], minlength=2).astype(float))
            w = np.exp(p - p.max())
            z[e] = int(rng.random() * w.sum() > w[0])
        hits += z[0] == z[1]
    assert abs(hits / 4000 - pair) < 0.04


def test_greedy_sweeps_find_planted_communities(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(80):
        rate = np.full(6, 0.3)
        rate[(i % 2) * 3 : (i % 2) * 3 + 3] = 8
        v = rng.poisson(rate)
        rows += [(i, i + 1000, int(g), float(v[g])) for g in range(6) if v[g]]
    p = cluster.profiles(spark.createDataFrame(rows, "a long, b long, dim int, value double"))
    got = cluster.link_communities(p, 2, 6, 3, 2, 4, 1)
    labels = {r.a: r.label for r in got.collect()}
    again = {r.a: r.label for r in cluster.link_communities(p.repartition(3), 2, 6, 3, 2, 4, 1).collect()}
    assert labels == again
    truth = pairs(spark, [i % 2 for i in range(80)], [labels[i] for i in range(80)])
    assert score.ari(truth).first()[0] > 0.9


def test_upgma_cuts_at_the_threshold():
    m = np.array([[5, 0, 0, 0], [4.9, 0.1, 0, 0], [0, 0, 5, 0.2], [0, 0, 4.8, 0.1]])
    merges, labels = cluster.upgma(m, 0.5)
    assert len(merges) == 3 and labels.tolist() == [0, 0, 1, 1] and merges[0][2] > merges[2][2]


def test_effect_with_known_nuisances_and_t(spark):
    rows = [("p", i % 2, 0.5, 0.0, 1.0, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "pair string, treated int, e double, m0 double, m1 double, y double")
    r = lra.overlap_effect(df, ["pair"]).first()
    assert r.theta == 1.0 and r.n_treated == 10 and abs(r.ess - 20) < 1e-9
    assert math.isnan(lra.overlap_effect(df.filter("treated = 1"), ["pair"]).first().theta)
    assert abs(lra.t_two_sided(2.228, 10) - 0.05) < 1e-4 and abs(lra.t_two_sided(1.96, 1e7) - 0.05) < 1e-4
    assert math.isnan(lra.t_two_sided(float("nan"), 5))
    inf = float("inf")
    assert abs(lra.t_two_sided(-1.959964, inf) - 0.05) < 1e-6 and lra.t_two_sided(inf, 4) == 0
    assert abs(lra.t_crit_975(10) - 2.228139) < 1e-5 and abs(lra.t_crit_975(inf) - 1.959964) < 1e-6 and abs(lra.t_crit_975(1) - 12.7062) < 1e-3
    assert math.isnan(lra.t_crit_975(0))


def test_estimates_are_combined(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("two", 1.0, 0.5, 20.0), ("two", 2.0, 0.5, 30.0), ("two", nan, 0.5, 30.0), ("two", 9.0, 0.5, nan), ("two", 9.0, inf, 5.0), ("same", 1.0, 0.5, 20.0), ("same", 1.0, 0.5, 40.0)]
    rows += [("one", 3.0, 0.25, 7.0), ("none", 1.0, 0.5, nan), ("none", 1.0, nan, 5.0), ("exact", 1.0, 0.0, 6.0), ("exact", 1.0, 0.0, 9.0), ("wide", 1.0, 0.5, inf), ("wide", 2.0, 0.5, inf), ("lone", 1.0, 0.5, 0.0), ("lone", 2.0, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "pair string, theta double, se double, df double")
    got = {r.pair: r for r in lra.rubin(df, ["pair"]).collect()}
    lam = 0.75 / (0.25 + 0.75)  # within 0.25, between 0.5, times 1.5
    seen = 21 / 23 * 20 * (1 - lam)
    old = 1 / lam**2
    assert got["two"].theta == 1.5 and abs(got["two"].se - 1) < 1e-12 and abs(got["two"].df - old * seen / (old + seen)) < 1e-12
    assert (got["same"].theta, got["same"].se) == (1.0, 0.5) and abs(got["same"].df - 21 / 23 * 20) < 1e-12
    assert tuple(got["one"])[1:] == (3.0, 0.25, 7.0) and all(math.isnan(x) for x in tuple(got["none"])[1:])
    assert tuple(got["exact"])[1:3] == (1.0, 0.0) and abs(got["wide"].df - old) < 1e-12

    avg = {r.pair: r for r in lra.abf_average(df, ["pair"]).collect()}
    shrink = 100 * 0.25 / (0.25 + 100 * 0.25)
    bf = [math.exp(0.5 * math.log(1 - shrink) + 0.5 * (t / 0.5) ** 2 * shrink) for t in (1.0, 2.0)]
    w = [b / sum(bf) for b in bf]
    theta = w[0] + 2 * w[1]
    assert abs(avg["two"].theta - theta) < 1e-12 and abs(avg["two"].se ** 2 - sum(x * (0.25 + (t - theta) ** 2) for x, t in zip(w, (1, 2), strict=True))) < 1e-12
    assert abs(avg["two"].df - 1 / (w[0] / 20 + w[1] / 30)) < 1e-9 and tuple(avg["one"])[1:] == (3.0, 0.25, 7.0)
    assert math.isnan(avg["none"].theta) and avg["exact"].theta == 1 and avg["exact"].se == 0 and len(avg) == 7
    assert avg["wide"].df == inf and got["lone"].df == 0 and math.isnan(got["lone"].theta)


def test_clustered_counts_clusters_with_a_sum(spark):
    rows = [("a", 1, 2.0), ("a", 2, -1.0), ("a", 3, 1.0), ("a", 3, -1.0), ("b", 1, -3.0), ("b", 2, 0.0), ("c", 1, 0.0)]
    got = {r.k: r for r in stats.clustered(spark.createDataFrame(rows, "k string, c int, v double"), ["k"], "c", "v").collect()}
    assert abs(got["a"].sd - math.sqrt(5 * 2)) < 1e-12 and got["a"].effective == 2
    assert got["b"].sd == 3 and math.isnan(got["b"].effective) and got["c"].sd == 0 and math.isnan(got["c"].effective)


def test_cross_fit_recovers_a_planted_effect(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    t = (rng.random(600) < 1 / (1 + np.exp(-x))).astype(int)
    y = 2 * x + 0.7 * t + rng.normal(size=600) * 0.3
    rows = [("p", i, i % 5, int(t[i]), float(y[i]), float(x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "pair string, cell long, fold int, treated int, y double, cx double")
    got = lra.overlap_effect(effect.cross_fit(df, ["cx"]), ["pair"]).first()
    assert abs(got.theta - 0.7) < 0.1


def test_em_and_vectors(spark):
    fit, names = latent.em_proportions({"u": [1.0, 0.0], "v": [0.0, 1.0]})
    df = spark.createDataFrame([(1, [3.0, 1.0]), (2, [0.0, 0.0])], "cell long, counts array<double>")
    got = {r.cell: r.proportions for r in df.mapInArrow(fit, "cell long, proportions array<double>").collect()}
    assert np.allclose(got[1], [0.75, 0.25]) and got[2] == [0.0, 0.0]
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.0, 0.0], 1)], "cell long, embedding array<float>, label int")
    near = {r.cell: r.label for r in latent.nearest_centroid(v, latent.centroids(v, "label")).collect()}
    assert near[1] == near[2] == 0 and near[3] == 1


def test_degenerate_tables(spark):
    none = spark.createDataFrame([], "cell long, feature string, count double")
    assert pool.normalised(none).count() == 0 and pool.totals(none, "cell").count() == 0
    edges = spark.createDataFrame([], "a long, b long, community int")
    assert pool.membership(edges).count() == 0 and lra.strata(edges).count() == 0
    zero = spark.createDataFrame([(1, "f", 0.0)], "cell long, feature string, count double")
    assert pool.normalised(zero).first()["value"] == 0.0


def test_permutation_test_against_plain_numpy(spark):
    rng = np.random.default_rng(5)
    n, perms, seed, stratum = 40, 60, 3, 2
    base = rng.gamma(3, size=n)
    values = {"a": (base, base + rng.gamma(2, size=n)), "b": (rng.gamma(3, size=n), rng.gamma(3, size=n)), "c": (base, rng.gamma(1, size=n)), "flat": (np.zeros(n), base)}
    row = (stratum, [(k, l.tolist(), r.tolist()) for k, (l, r) in values.items()])
    df = spark.createDataFrame([row], "stratum long, pairs array<struct<pair:string,l:array<double>,r:array<double>>>")
    got = {r.pair: r for r in lra.permutation_test(df, perms, seed).collect()}
    draw = np.random.default_rng([seed, stratum])
    orders = [draw.permutation(n) for _ in range(perms)]
    obs, null = {}, {}
    for k, (l, r) in values.items():
        l, r = l - sum(l) / n, r - sum(r) / n
        obs[k] = sum(l[i] * r[i] for i in range(n)) / n
        null[k] = [sum(l[i] * r[o[i]] for i in range(n)) / n for o in orders]
    live = [k for k in values if k != "flat"]
    least = [min(1 - (sum(x < null[k][j] for x in null[k]) + 0.5) / perms for k in live) for j in range(perms)]
    for k in live:
        p = (sum(x > obs[k] for x in null[k]) + 0.5) / (perms + 1)
        assert abs(got[k].stat - obs[k]) < 1e-9 and abs(got[k].p_empirical - p) < 1e-9
        assert abs(got[k].fwer - (1 + sum(x <= p for x in least)) / (perms + 1)) < 0.5 / perms
        assert abs(got[k].z - (obs[k] - np.mean(null[k])) / np.std(null[k])) < 1e-6
    assert all(math.isnan(got["flat"][c]) for c in ("z", "p_empirical", "fwer"))


def test_permutation_query_tests_every_pair(spark):
    from pairloom.plans import catalog
    from pairloom.sources import views

    got = catalog.QUERIES["m41_permutation_test"](spark, "/root/testdata/sf0.001").collect()
    pairs = {f"{r.ligand}:{r.receptor}" for r in views.pairs(spark).collect()}
    strata = {r.stratum for r in got}
    assert strata and {(r.stratum, r.pair) for r in got} == {(k, p) for k in strata for p in pairs}


def test_permuted_moran_against_plain_numpy(spark):
    rng = np.random.default_rng(8)
    cells = [(i, i % 2) for i in range(24)]
    edges = [(i, i + 2, i % 2) for i in range(22)]
    x = {f: {i: float(rng.integers(0, 5)) for i, _ in cells if i % 7} for f in "uv"}
    x["u"] |= {i: float(i) for i, _ in cells}
    sparse = [(i, f, v) for f in x for i, v in x[f].items() if v]
    e, c, v = spark.createDataFrame(edges, "a long, b long, section int"), spark.createDataFrame(cells, "cell long, section int"), spark.createDataFrame(sparse, "cell long, feature string, count double")
    got = {r.feature: r for r in lra.permuted_moran(e, c, v, 50, 9).collect()}
    plain = {r.feature: r.moran for r in lra.moran_by_feature(e, v.select("cell", "feature", F.col("count").alias("value")), 24).collect()}
    assert set(got) == set(plain) == {"u", "v"}
    own = [[i for i, s in cells if s == k] for k in range(2)]
    draws = [np.random.default_rng([9, k]) for k in range(2)]
    orders = [[d.permutation(12) for d in draws] for _ in range(50)]
    for f in x:
        def moran(at):
            z = {i: x[f].get(at[i], 0.0) for i in at}
            mean = sum(z.values()) / 24
            return 24 / 44 * sum(2 * (z[a] - mean) * (z[b] - mean) for a, b, _ in edges) / sum((u - mean) ** 2 for u in z.values())

        null = [moran({own[k][j]: own[k][o[k][j]] for k in range(2) for j in range(12)}) for o in orders]
        assert abs(got[f].moran - plain[f]) < 1e-9 and abs(got[f].null_mean - np.mean(null)) < 1e-9
        assert abs(got[f].p - (1 + sum(u >= plain[f] - 1e-9 for u in null)) / 51) < 1e-12
    assert got["u"].p == 1 / 51


def test_moran_query_tests_every_feature_by_2000_shuffles(spark):
    from pairloom.plans import catalog
    from pairloom.sources import views

    got = catalog.QUERIES["m43_permuted_moran"](spark, "/root/testdata/sf0.001").collect()
    assert {r.feature for r in got} == {r.feature for r in views.counts(spark, "/root/testdata/sf0.001").select("feature").distinct().collect()}
    assert all(abs(r.p * 2001 - round(r.p * 2001)) < 1e-6 for r in got)


def test_greedy_sweeps_end_when_no_edge_moves(spark, monkeypatch):
    rows = [(i, i + 100, int(i % 2 * 3 + j), 9.0) for i in range(20) for j in range(3)]
    p = cluster.profiles(spark.createDataFrame(rows, "a long, b long, dim int, value double"))
    swept, n = cluster._swept, []
    monkeypatch.setattr(cluster, "_swept", lambda *a: n.append(a[-1]) or swept(*a))
    start = p.withColumn("label", (F.col("a") % 2).cast("int")).select("a", "b", "label", "cols", "vals")
    got = cluster.refine(start, 2, 6, 0, 10, 2, 1).collect()
    assert len(n) == 1 and all(r.label == r.a % 2 for r in got)
    n.clear()
    labels = {r.a: r.label for r in cluster.refine(start.withColumn("label", (F.col("a") % 10 == 0).cast("int")), 2, 6, 0, 10, 2, 1).collect()}
    assert 1 < len(n) < 10 and all(labels[i] == labels[i % 2] for i in labels)


CAPPED = ["m6_dictionary_merge", "m18_shared_difference_svd", "m23_em_proportions", "m25_heldout_ablation", "m38_sup_t_band", "m48_single_cell_baseline", "m57_producer_calibration", "o4_heaviest_first", "g50_paired_tests"]


@pytest.mark.parametrize("name", CAPPED)
def test_more_rows_than_the_driver_takes_raise(spark, monkeypatch, name):
    from pairloom.plans import catalog

    all_rows = pool.collected
    assert len(all_rows(spark.range(3), 3)) == 3
    monkeypatch.setattr(pool, "collected", lambda rows, most: all_rows(rows, 1))
    with pytest.raises(ValueError, match="more than 1 rows"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_bh_and_by_over_slices_ties_and_large_families(spark):
    n = 120_000
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.random(n // 2), 10.0 ** -rng.uniform(0, 320, n // 4), np.repeat([0.0, 1.0, 0.25, 1 / 64], n // 16)])
    order = np.argsort(p, kind="stable")
    s = p[order] * n / np.arange(1, n + 1)
    want = np.empty(n)
    want[order] = np.minimum(np.minimum.accumulate(s[::-1])[::-1], 1)
    for x in (0.0, 1.0, 0.25, 1 / 64):  # equal p share the least value
        want[p == x] = want[p == x].min()
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "p": p})).withColumn("f", F.lit(None).cast("string"))
    df = df.unionByName(spark.createDataFrame([(-1, float("nan"), "x")], "i long, p double, f string"))
    for form, times in ((stats.bh, 1.0), (stats.by_adjust, (1 / np.arange(1, n + 1)).sum())):
        start = time.perf_counter()
        got = form(df, ["f"], "p", "q").toPandas().set_index("i")["q"]
        assert time.perf_counter() - start < 60  # a window that reads on to its end takes 7 * 10^9 steps here
        assert len(got) == n + 1 and np.isnan(got[-1])
        np.testing.assert_allclose(got.loc[np.arange(n)], np.minimum(want * times, 1), rtol=1e-12)


def test_nearest_centroid_is_linear_in_the_width(spark):
    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(4000, 128)), rng.normal(size=(12, 128))
    c[5] = c[2]  # a tie: to the least label
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [1.0, None] * 64), (-3, [0.0] * 128), (-4, [1.0])]
    vectors = spark.createDataFrame(rows, "cell long, embedding array<double>").cache()
    centers = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "label int, centroid array<double>")
    vectors.count()
    start = time.perf_counter()
    got = {r.cell: (r.label, r.cosine) for r in latent.nearest_centroid(vectors, centers).collect()}
    assert time.perf_counter() - start < 20
    cosine = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    cosine[:, 5] = -2
    assert all(got[i][0] == cosine[i].argmax() and abs(got[i][1] - cosine[i].max()) < 1e-12 for i in range(4000))
    assert got[-1] == (0, None) and got[-2] == (0, None) and got[-4] == (0, None) and got[-3] == (0, 0.0)
