"""Queries over iterative and numeric operators (no SQL unless it can express them)."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import cluster as K
from ..operators import effect as X
from ..operators import graph as G
from ..operators import latent
from ..operators import lra as L
from ..operators import pool as P
from ..operators import score as C
from ..operators import shuffles
from ..operators import stats as S
from ..session import cut
from ..sources import views as V
from ..sources.views import BOTH, CELLS, COMMUNITIES, CONTACTS, COUNTS, sql
from .registry import query


def _dims(counts):
    names = counts.select("feature").distinct().orderBy("feature")
    return names.withColumn("dim", (F.row_number().over(W.orderBy("feature")) - 1).cast("int"))


def _profiles(s, d):
    counts = V.counts(s, d)
    pooled = G.pool_endpoints(V.contacts(s, d), counts).join(F.broadcast(_dims(counts)), "feature")
    return K.profiles(pooled.select("a", "b", "dim", F.col("count").alias("value")))


@query("m1_link_communities")
def m1(s, d):
    return K.link_communities(_profiles(s, d), 4, 25, gibbs=100, greedy=10, blocks=8, seed=1)


@query("m2_greedy_sweep")
def m2(s, d):
    p = _profiles(s, d).select("a", "b", F.pmod(F.col("a") + F.col("b"), F.lit(4)).cast("int").alias("label"), "cols", "vals")
    return K.sweep(p, 4, 25, 8).select("a", "b", "label")


@query("g15_log_marginal")
def g15(s, d):
    p = _profiles(s, d).select("a", "b", F.pmod(F.col("a") + F.col("b"), F.lit(4)).cast("int").alias("label"), "cols", "vals")
    stats = K.statistics(p, 4, 25)
    return s.createDataFrame([(K.log_marginal(stats[0], stats[1]),)], "log_marginal double")


@query("m6_dictionary_merge")
def m6(s, d):
    st = P.community_stats(V.communities(s, d), G.pool_endpoints(V.contacts(s, d), V.counts(s, d)))
    rows = P.collected(st.select("community", "feature", F.log1p("total").alias("v")), 100_000)
    k, g = sorted({r["community"] for r in rows}), sorted({r["feature"] for r in rows})
    m = np.zeros((len(k), len(g)))
    for r in rows:
        m[k.index(r["community"]), g.index(r["feature"])] = r["v"]
    merges, labels = K.upgma(m, 0.0)
    return s.createDataFrame([(i, int(a), int(b), float(x), int(n)) for i, (a, b, x, n) in enumerate(merges)], "merge_id int, left int, right int, score double, n_leaves int")


@query("m7_graph_coarsening")
def m7(s, d):
    counts = V.counts(s, d)
    full = V.cells(s, d).select("cell").join(F.broadcast(_dims(counts))).join(counts, ["cell", "feature"], "left")
    vec = full.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.coalesce("count", F.lit(0.0)).alias("v")))), lambda x: x["v"]).alias("embedding"))
    return K.coarsen(V.contacts(s, d), vec.withColumn("n", F.lit(1)), 3)


@query("m8_spatial_seeding", sql(CELLS, "b AS (SELECT section, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1)", "SELECT cell, section * 16 + CAST(least(3, floor((x - x0) / (x1 - x0) * 4)) * 4 + least(3, floor((y - y0) / (y1 - y0) * 4)) AS INT) AS seed FROM cells JOIN b USING (section)"))
def m8(s, d):
    c = V.cells(s, d)
    b = c.groupBy("section").agg(*[f(k).alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.min, F.max))])
    tile = [F.least(F.lit(3), F.floor((F.col(k) - F.col(f"{k}0")) / (F.col(f"{k}1") - F.col(f"{k}0")) * 4)) for k in "xy"]
    return c.join(b, "section").select("cell", (F.col("section") * 16 + (tile[0] * 4 + tile[1]).cast("int")).alias("seed"))


@query("m11_random_projection")
def m11(s, d):
    counts = V.counts(s, d)
    basis = counts.select("feature").distinct().select("feature", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"))
    u, v = (E.keyed_uniform(k, F.col("feature"), F.col("dim")) for k in (21, 22))
    basis = basis.withColumn("w", F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v))
    return counts.join(F.broadcast(basis), "feature").groupBy("cell", "dim").agg(F.sum(F.col("count") * F.col("w")).alias("value"))


@query("m12_module_pairs", sql(CELLS, COUNTS, CONTACTS, "m AS (SELECT cell, substr(feature, 7, 1) AS module, sum(count) AS v FROM counts GROUP BY 1, 2)", "SELECT a, b, p.module AS one, q.module AS two, p.v * q.v AS value FROM contacts JOIN m p ON p.cell = a JOIN m q ON q.cell = b AND q.module::INT = p.module::INT + 1"))
def m12(s, d):
    m = V.counts(s, d).groupBy("cell", F.substring("feature", 7, 1).alias("module")).agg(F.sum("count").alias("v"))
    one = m.select(F.col("cell").alias("a"), F.col("module").alias("one"), F.col("v").alias("v1"))
    two = m.select(F.col("cell").alias("b"), F.col("module").alias("two"), F.col("v").alias("v2"))
    return V.contacts(s, d).join(one, "a").join(two, "b").filter("cast(two AS INT) = cast(one AS INT) + 1").select("a", "b", "one", "two", (F.col("v1") * F.col("v2")).alias("value"))


@query("m15_local_moves")
def m15(s, d):
    return K.local_moves(V.contacts(s, d), V.cells(s, d), 6)


@query("m15_modularity", sql(CELLS, CONTACTS, BOTH, "m AS (SELECT count(*) AS m FROM contacts), i AS (SELECT count(*) AS i FROM contacts JOIN cells p ON p.cell = a JOIN cells q ON q.cell = b WHERE p.kind = q.kind), d AS (SELECT sum(n * n) AS d FROM (SELECT kind, count(*)::DOUBLE AS n FROM ends JOIN cells ON cell = src GROUP BY 1))", "SELECT round(i / m - d / (4.0 * m * m), 9) AS modularity FROM m, i, d"))
def m15_modularity(s, d):
    return K.label_modularity(V.contacts(s, d), V.cells(s, d).select("cell", F.col("kind").alias("label"))).select(F.round("modularity", 9).alias("modularity"))


@query("m16_spherical_kmeans")
def m16(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), "embedding")
    return K.spherical_kmeans(e, 10, 8, 5)


@query("m17_batch_effects")
def m17(s, d):
    """Folds by section within buckets of similar cells, recentred so that their geometric mean over sections is one."""
    counts, cells = V.counts(s, d), V.cells(s, d).select("cell", "section", F.col("kind").alias("bucket"))
    met = counts.join(cells, "cell").groupBy("section", "bucket", "feature").agg(F.sum("count").alias("c"))
    total = F.sum("c").over(W.partitionBy("section", "bucket"))
    others = F.sum("c").over(W.partitionBy("bucket", "feature")) - F.col("c")
    mass = F.sum("c").over(W.partitionBy("bucket")) - total
    fold = met.withColumn("expected", total * (others + 1) / (mass + 1))
    delta = fold.groupBy("feature", "section").agg(F.log((F.sum("c") + 1) / (F.sum("expected") + 1)).alias("l"))
    return delta.select("feature", "section", F.exp(F.col("l") - F.avg("l").over(W.partitionBy("feature"))).alias("delta"))


@query("m18_shared_difference_svd")
def m18(s, d):
    pooled = G.shared_difference(V.contacts(s, d), V.counts(s, d), "section")
    rows = P.collected(pooled.groupBy("section", "feature").agg(F.log1p(F.avg("shared")).alias("s"), F.log1p(F.avg("difference")).alias("x")), 1_000_000)
    m = pd.DataFrame(rows, columns=["section", "feature", "s", "x"])
    t = np.concatenate([m.pivot(index="feature", columns="section", values=c).fillna(0).sort_index().to_numpy() for c in ("s", "x")])
    t = t - t.mean(1, keepdims=True)
    u, w, _ = np.linalg.svd(t, full_matrices=False)
    names = sorted(m["feature"].unique())
    rows = [(("shared", "difference")[i // len(names)], names[i % len(names)], k, float(u[i, k] * np.sign(u[np.abs(u[:, k]).argmax(), k])), float(w[k])) for i in range(len(u)) for k in range(3)]
    return s.createDataFrame(rows, "channel string, feature string, component int, loading double, singular double")


def _mixture(s, d):
    counts = V.counts(s, d)
    dims = _dims(counts)
    kinds = V.cells(s, d).select("cell", F.col("kind").alias("group"))
    profile = P.collected(P.pseudobulk(counts, kinds).join(dims, "feature"), 100_000)
    table = {k: [0.0] * 25 for k in sorted({r["group"] for r in profile})}
    for r in profile:
        table[r["group"]][r["dim"]] = r["count"]
    full = V.cells(s, d).select("cell").join(F.broadcast(dims)).join(counts, ["cell", "feature"], "left")
    arrays = full.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.coalesce("count", F.lit(0.0)).alias("v")))), lambda x: x["v"]).alias("counts"))
    return arrays, table


@query("m23_em_proportions")
def m23(s, d):
    arrays, table = _mixture(s, d)
    fit, names = latent.em_proportions(table)
    out = arrays.mapInArrow(fit, "cell long, proportions array<double>")
    return out.select("cell", F.posexplode("proportions").alias("k", "share")).withColumn("profile", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)).select("cell", "profile", "share")


@query("m24_retrieval_impute", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e, label FROM embeddings), r AS (SELECT p.vec_id AS a, q.vec_id AS b, array_distance(p.e, q.e) AS d, row_number() OVER (PARTITION BY p.vec_id ORDER BY array_distance(p.e, q.e), q.vec_id) AS rank FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id), w AS (SELECT a, b, exp(-d * d / 0.5) AS w FROM r WHERE rank <= 5) SELECT a, 'm' || (b % 3) AS feature, round(sum(w * (b % 10)) / any_value(t), 6) AS value FROM w JOIN (SELECT a, sum(w) AS t FROM w GROUP BY 1) USING (a) GROUP BY 1, 2")
def m24(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), "embedding", F.col("label").alias("section"))
    near = latent.vector_knn(e, 5)
    values = e.select("cell", F.concat(F.lit("m"), (F.col("cell") % 3).cast("string")).alias("feature"), (F.col("cell") % 10).cast("double").alias("count"))
    return latent.retrieve(e, near, values, 0.5).withColumn("value", F.round("value", 6))


@query("m25_heldout_ablation")
def m25(s, d):
    """Held-out log-likelihood of the features that hash to the test half, from mixtures fitted on the others."""
    arrays, table = _mixture(s, d)
    test = np.arange(25) % 2 == 1
    fit, names = latent.em_proportions({k: [0.0 if test[i] else x for i, x in enumerate(v)] for k, v in table.items()})
    p = np.array([table[n] for n in names]) + 1e-9
    q = p[:, test] / p[:, test].sum(1, keepdims=True)
    masked = arrays.withColumn("counts", F.transform("counts", lambda v, i: F.when(i % 2 == 1, 0.0).otherwise(v)))
    pi = masked.mapInArrow(fit, "cell long, proportions array<double>")
    met = arrays.join(pi, "cell").select("cell", F.posexplode(F.filter("counts", lambda v, i: i % 2 == 1)).alias("i", "x"), "proportions")
    rate = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in q.T]), F.col("i") + 1)
    mixed = F.aggregate(F.zip_with("proportions", rate, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return met.groupBy("cell").agg(F.sum(F.when(F.col("x") > 0, F.col("x") * F.log(F.greatest(mixed, F.lit(1e-300)))).otherwise(0.0)).alias("llik"), F.sum("x").alias("counts"))


def _receivers(s, d):
    dose = L.contact_dose(V.contacts(s, d), V.counts(s, d), "Brand#23", P.totals(V.counts(s, d), "cell").select("cell", (F.col("total") / 500).alias("size_factor")))
    y = V.counts(s, d).filter("feature = 'Brand#24'").select("cell", F.log1p("count").alias("y"))
    cells = V.cells(s, d).withColumnRenamed("y", "cy0")
    rows = cells.join(dose, "cell").join(y, "cell", "left").na.fill(0.0, ["y"])
    return rows.select(F.lit("Brand#23:Brand#24").alias("pair"), "cell", F.pmod(F.xxhash64("section"), F.lit(5)).cast("int").alias("fold"), (F.col("dose") > 25).cast("int").alias("treated"), "y", F.col("x").alias("cx"), "cy0", F.col("donor").cast("double").alias("cd"), "section")


@query("m32_cross_fitted_nuisances")
def m32(s, d):
    return X.cross_fit(_receivers(s, d).drop("section", "cy0"), ["cx", "cd"])


@query("m40_contact_effect")
def m40(s, d):
    fitted = X.cross_fit(_receivers(s, d).drop("section", "cy0"), ["cx", "cd"]).join(V.cells(s, d).select("cell", "section"), "cell")
    e = F.col("e")
    h = e * (1 - e)
    num = F.when(F.col("treated") == 1, h * (F.col("m1") - F.col("m0")) + (1 - e) * (F.col("y") - F.col("m1"))).otherwise(h * (F.col("m1") - F.col("m0")) - e * (F.col("y") - F.col("m0")))
    out = L.tile_jackknife(fitted.withColumn("h", h).withColumn("num", num), ["pair"], "section", "num", "h").withColumn("df", F.lit(24.0)).withColumn("t", F.col("theta") / F.col("se"))
    return S.bh(L.with_p(out, "t", "df", "p").withColumn("fam", F.lit(0)), ["fam"], "p", "q").drop("fam")


@query("m33_grams", sql(CELLS, "v AS (SELECT donor, [1.0, x / 1000, y / 1000] AS d, y AS r FROM cells), e AS (SELECT donor, i - 1 AS i, j - 1 AS j, d[i] * d[j] AS v FROM v, range(1, 4) a(i), range(1, 4) b(j) UNION ALL SELECT donor, i - 1, -1, d[i] * r FROM v, range(1, 4) a(i))", "SELECT donor, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(v), 3) AS v FROM e GROUP BY 1, 2, 3"))
def m33(s, d):
    rows = V.cells(s, d).select("donor", F.array(F.lit(1.0), F.col("x") / 1000, F.col("y") / 1000).alias("design"), "y")
    return X.gram(rows, "design", "y", ["donor"]).withColumn("v", F.round("v", 3))


@query("m31_identity_bins")
def m31(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), "embedding")
    return X.identity_bits(e, 6, 64, 4)


@query("m41_permutation_test")
def m41(s, d):
    st = L.strata(cut(V.communities(s, d).select("a", "b", "community")))
    return shuffles.permutation_test(st.withColumnRenamed("community", "stratum"), V.counts(s, d), V.pairs(s), 1000, 3)


@query("m43_permuted_moran")
def m43(s, d):
    return L.permuted_moran(V.contacts(s, d), V.cells(s, d), V.counts(s, d), 2000, 5)


@query("m45_simulator")
def m45(s, d):
    return X.simulate(s, 4, 200, 24, 4, 2.0, 7)


@query("m47_pair_sampling", sql(CELLS, CONTACTS, "SELECT a, b FROM (SELECT a, b, row_number() OVER (ORDER BY md5('9:' || a || ':' || b), a, b) AS r FROM contacts) WHERE r <= 300"))
def m47(s, d):
    return V.contacts(s, d).orderBy(F.md5(F.concat_ws(":", F.lit("9"), "a", "b")), "a", "b").limit(300).select("a", "b")


@query("g51_mean_of_pairs", sql(CELLS, CONTACTS, "SELECT cell, round(avg(distance), 6) AS mean FROM (SELECT a AS cell, distance FROM contacts UNION ALL SELECT b, distance FROM contacts) GROUP BY 1"))
def g51(s, d):
    return G.endpoints(V.contacts(s, d), "distance").groupBy("cell").agg(F.round(F.avg("distance"), 6).alias("mean"))


@query("g59_weighted_draws", sql(COUNTS, "w AS (SELECT feature, cell, sum(count) OVER (PARTITION BY feature ORDER BY cell) - count AS low, sum(count) OVER (PARTITION BY feature ORDER BY cell) AS high, sum(count) OVER (PARTITION BY feature) AS total FROM counts), u AS (SELECT feature, i, ('0x' || substr(md5('13:' || feature || ':' || i), 1, 8))::BIGINT / 4294967296.0 AS u FROM (SELECT DISTINCT feature FROM counts), range(0, 5) t(i))", "SELECT feature, CAST(i AS INT) AS draw, cell FROM u JOIN w USING (feature) WHERE u * total >= low AND u * total < high"))
def g59(s, d):
    c = V.counts(s, d)
    w = W.partitionBy("feature").orderBy("cell")
    run = c.select("feature", "cell", F.sum("count").over(w).alias("high"), (F.sum("count").over(w) - F.col("count")).alias("low"), F.sum("count").over(W.partitionBy("feature")).alias("total"))
    u = c.select("feature").distinct().select("feature", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("draw"))
    u = u.withColumn("u", E.keyed_uniform(13, F.col("feature"), F.col("draw")))
    return u.join(run, "feature").filter("u * total >= low AND u * total < high").select("feature", "draw", "cell")


@query("w10_curve_quantiles", sql(CELLS, COUNTS, "q AS (SELECT feature, list_sort(list(count)) AS v, count(*) AS n FROM counts GROUP BY 1)", "SELECT feature, q, v[CAST(floor((n - 1) * q + 0.5) AS INT) + 1] AS tau FROM q, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(q)"))
def w10(s, d):
    out = None
    for q in (0.25, 0.5, 0.75):
        one = S.quantile_by(V.counts(s, d), ["feature"], "count", q, "tau").select("feature", F.lit(q).alias("q"), "tau")
        out = one if out is None else out.unionByName(one)
    return out


@query("w11_depth_basis", sql(COUNTS, "t AS (SELECT cell, ln(1 + sum(count)) AS depth FROM counts GROUP BY 1), q AS (SELECT list_sort(list(depth)) AS v, count(*) AS n FROM t)", "SELECT cell, round(greatest(depth - v[CAST(floor((n - 1) * 0.5 + 0.5) AS INT) + 1], 0), 7) AS over FROM t, q"))
def w11(s, d):
    t = P.totals(V.counts(s, d), "cell").select("cell", F.log1p("total").alias("depth"))
    return t.join(F.broadcast(S.quantile_by(t, [], "depth", 0.5, "k"))).select("cell", F.round(F.greatest(F.col("depth") - F.col("k"), F.lit(0.0)), 7).alias("over"))


@query("m53_spatial_genes_moments", sql(CELLS, COUNTS, "n AS (SELECT count(*) AS n, avg(x) AS mx, var_pop(x) AS vx FROM cells)", "SELECT feature, round(power(sum(count * (x - mx)), 2) / any_value(vx) / (sum(count * count) - sum(count) * sum(count) / any_value(n)), 7) AS stat FROM counts JOIN cells USING (cell), n GROUP BY 1"))
def m53(s, d):
    cells = V.cells(s, d)
    one = cells.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.var_pop("x").alias("vx"))
    met = V.counts(s, d).join(cells.select("cell", "x"), "cell").join(F.broadcast(one))
    q = F.sum(F.col("count") * (F.col("x") - F.col("mx")))
    spread = F.sum(F.col("count") * F.col("count")) - F.sum("count") * F.sum("count") / F.first("n")
    return met.groupBy("feature").agg(F.round(q * q / F.first("vx") / spread, 7).alias("stat"))


REG = "reg AS (SELECT s_suppkey AS tf, p_partkey AS target, CASE WHEN (s_suppkey + p_partkey) % 5 = 0 THEN -1 ELSE 1 END AS mor FROM supplier JOIN part ON p_partkey % 100 = s_suppkey % 100)"


@query("j26_regulon_dedup", sql(REG, "SELECT tf % 10 AS tf, target % 100 AS target, min(mor) AS mor FROM reg GROUP BY 1, 2 HAVING count(DISTINCT mor) = 1"))
def j26(s, d):
    reg = V.table(s, d, "supplier").join(V.table(s, d, "part"), F.col("p_partkey") % 100 == F.col("s_suppkey") % 100)
    reg = reg.select((F.col("s_suppkey") % 10).alias("tf"), (F.col("p_partkey") % 100).alias("target"), F.when((F.col("s_suppkey") + F.col("p_partkey")) % 5 == 0, -1).otherwise(1).alias("mor"))
    return reg.groupBy("tf", "target").agg(F.min("mor").alias("mor"), F.countDistinct("mor").alias("k")).filter("k = 1").select("tf", "target", "mor")


@query("j27_one_to_one", "WITH o AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part WHERE p_size < 3) SELECT a, b FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM o) WHERE na <= 2 AND nb <= 4")
def j27(s, d):
    o = V.table(s, d, "part").filter("p_size < 3").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct()
    return o.withColumn("na", F.count(F.lit(1)).over(W.partitionBy("a"))).withColumn("nb", F.count(F.lit(1)).over(W.partitionBy("b"))).filter("na <= 2 AND nb <= 4").select("a", "b")


@query("j14_scarcest_subunit", sql(CELLS, COUNTS, "SELECT cell, least(coalesce(l.count, 0), coalesce(r.count, 0)) AS complex FROM cells LEFT JOIN (FROM counts WHERE feature = 'Brand#11') l USING (cell) LEFT JOIN (FROM counts WHERE feature = 'Brand#34') r USING (cell)"))
def j14(s, d):
    units = s.createDataFrame([("Brand#11",), ("Brand#34",)], "feature string")
    c = V.counts(s, d).join(F.broadcast(units), "feature").groupBy("cell").agg(F.min("count").alias("m"), F.count(F.lit(1)).alias("k"))
    return V.cells(s, d).select("cell").join(c, "cell", "left").select("cell", F.when(F.col("k") == 2, F.col("m")).otherwise(0.0).alias("complex"))


@query("j13_resolve_pairs", sql(COUNTS, "c(pair, unit) AS (VALUES ('A_B', 'Brand#11'), ('A_B', 'Brand#12'), ('C_D', 'Brand#13'), ('C_D', 'Brand#99'))", "SELECT pair, count(*) AS units FROM c SEMI JOIN counts ON feature = unit GROUP BY 1 HAVING count(*) = 2"))
def j13(s, d):
    units = s.createDataFrame([("A_B", ["Brand#11", "Brand#12"]), ("C_D", ["Brand#13", "Brand#99"])], "pair string, units array<string>")
    flat = units.select("pair", F.size("units").alias("n"), F.explode("units").alias("feature"))
    met = flat.join(V.counts(s, d).select("feature").distinct(), "feature", "left_semi").groupBy("pair").agg(F.count(F.lit(1)).alias("units"), F.first("n").alias("n"))
    return met.filter("units = n").select("pair", "units")


@query("j24_signed_bfs", sql(CELLS, CONTACTS, BOTH, "e AS (SELECT src, dst, CASE WHEN (src + dst) % 3 = 0 THEN -1 ELSE 1 END AS sign FROM ends), d1 AS (SELECT dst AS node, sum(sign) AS s FROM e WHERE src = 1 GROUP BY 1), d2 AS (SELECT dst AS node, sum(s * sign) AS s FROM e JOIN d1 ON src = node WHERE dst <> 1 AND dst NOT IN (SELECT node FROM d1) GROUP BY 1)", "SELECT CAST(1 AS BIGINT) AS node, 0 AS distance, CAST(1 AS BIGINT) AS paths UNION ALL SELECT node, 1, CAST(s AS BIGINT) FROM d1 UNION ALL SELECT node, 2, CAST(s AS BIGINT) FROM d2"))
def j24(s, d):
    ends = G.both_ways(V.contacts(s, d)).withColumn("sign", F.when((F.col("src") + F.col("dst")) % 3 == 0, -1).otherwise(1))
    return signed_bfs(s.createDataFrame([(1,)], "node long"), ends, 2)


def signed_bfs(start, ends, depth):
    """node, distance, paths: the sum over shortest paths of their sign products, level by level."""
    seen = level = start.select("node", F.lit(0).alias("distance"), F.lit(1).cast("long").alias("paths"))
    for k in range(1, depth + 1):
        step = ends.join(level.select(F.col("node").alias("src"), "paths"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("paths") * F.col("sign")).alias("paths"))
        level = step.join(seen, "node", "left_anti").select("node", F.lit(k).alias("distance"), "paths")
        seen = seen.unionByName(level)
    return seen
