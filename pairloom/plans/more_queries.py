"""Further queries: name matching, programs, weights, cascades, placements, simulation, baselines."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import cluster as K
from ..operators import effect as X
from ..operators import graph as G
from ..operators import integrate, latent
from ..operators import lra as L
from ..operators import numeric as N
from ..operators import pool as P
from ..operators import score as C
from ..session import cut
from ..sources import views as V
from ..sources.views import CELLS, CONTACTS, COUNTS, FINE, sql
from .count_queries import BASE, TOT
from .lra_queries import FACTOR, factors
from .model_queries import _dims, _mixture, _profiles, _receivers
from .registry import query


@query("j4_knn_within_sections", sql(CELLS, CONTACTS, "SELECT a, b, CAST(rank AS INT) AS rank FROM near WHERE rank <= 3"))
def j4(s, d):
    return G.knn(V.cells(s, d), 3).select("a", "b", "rank")


@query("j17_profile_match", "WITH n AS (SELECT upper(p_type) AS name, p_brand AS ref FROM part WHERE p_size < 4) SELECT name, min(ref) AS ref FROM n GROUP BY 1 HAVING count(DISTINCT ref) <= 14")
def j17(s, d):
    n = V.table(s, d, "part").filter("p_size < 4").select(F.upper("p_type").alias("name"), F.col("p_brand").alias("ref"))
    return n.groupBy("name").agg(F.min("ref").alias("ref"), F.countDistinct("ref").alias("k")).filter("k <= 14").select("name", "ref")


@query("j18_batch_match", "SELECT n_name AS batch, coalesce(r_name, 'none') AS model FROM nation LEFT JOIN (FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def j18(s, d):
    r = V.table(s, d, "region").filter("r_regionkey < 3")
    return V.table(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("batch"), F.coalesce("r_name", F.lit("none")).alias("model"))


@query("j22_feature_network", "WITH e AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part WHERE p_size = 7) SELECT e.a, e.b, f.alias FROM e JOIN (SELECT DISTINCT p_brand AS name, replace(p_brand, 'Brand#', '') AS alias FROM part) f ON e.a = f.name OR starts_with(e.b, f.alias)")
def j22(s, d):
    p = V.table(s, d, "part")
    e = p.filter("p_size = 7").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")).distinct()
    f = p.select(F.col("p_brand").alias("name"), F.regexp_replace("p_brand", "Brand#", "").alias("alias")).distinct()
    return e.join(F.broadcast(f), (F.col("a") == F.col("name")) | F.startswith("b", "alias")).select("a", "b", "alias")


REG = "reg AS (SELECT p_partkey % 40 AS tf, p_brand AS target, CASE WHEN p_size % 4 = 0 THEN -1.0 ELSE 1.0 END AS mor FROM part), t AS (SELECT DISTINCT p_partkey % 40 AS tf, (p_partkey % 40) % 6 + 1 AS d, CASE WHEN (p_partkey % 40) % 3 = 0 THEN -2.0 ELSE 1.0 END AS s, (p_partkey % 40) % 5 AS receptor FROM part)"


@query("j25_receptor_programs", sql(REG, "w AS (SELECT receptor, target, sum(s / greatest(d, 1) * mor) AS w FROM t JOIN reg USING (tf) GROUP BY 1, 2)", "SELECT receptor, target, round(w, 7) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY receptor ORDER BY abs(round(w, 9)) DESC, target) AS r FROM w) WHERE r <= 8"))
def j25(s, d):
    p = V.table(s, d, "part")
    tf = F.col("p_partkey") % 40
    reg = p.select(tf.alias("tf"), F.col("p_brand").alias("target"), F.when(F.col("p_size") % 4 == 0, -1.0).otherwise(1.0).alias("mor"))
    t = p.select(tf.alias("tf"), (tf % 6 + 1).alias("d"), F.when(tf % 3 == 0, -2.0).otherwise(1.0).alias("s"), (tf % 5).alias("receptor")).distinct()
    w = t.join(reg, "tf").groupBy("receptor", "target").agg(F.sum(F.col("s") / F.greatest("d", F.lit(1)) * F.col("mor")).alias("w"))
    r = F.row_number().over(W.partitionBy("receptor").orderBy(F.desc(F.abs(F.round("w", 9))), "target"))
    return w.withColumn("r", r).filter("r <= 8").select("receptor", "target", F.round("w", 7).alias("weight"))


@query("j28_transmitted_pairs", "WITH u AS (SELECT p_type AS ligand, unnest(string_split(p_type, ' ')) AS unit FROM (SELECT DISTINCT p_type FROM part)) SELECT ligand FROM u GROUP BY 1 HAVING bool_and(length(unit) <= 8)")
def j28(s, d):
    u = V.table(s, d, "part").select(F.col("p_type").alias("ligand")).distinct().select("ligand", F.explode(F.split("ligand", " ")).alias("unit"))
    return u.groupBy("ligand").agg(F.bool_and(F.length("unit") <= 8).alias("ok")).filter("ok").select("ligand")


@query("j29_section_match", "SELECT n_name AS section, m AS name FROM nation, (VALUES ('CHINA'), ('KINGDOM'), ('N_1'), ('A')) t(m) WHERE 'x_' || n_name = m OR ends_with('x_' || n_name, '_' || m)")
def j29(s, d):
    m = s.createDataFrame([("CHINA",), ("KINGDOM",), ("N_1",), ("A",)], "name string")
    n = V.table(s, d, "nation").withColumn("full", F.concat(F.lit("x_"), "n_name"))
    return n.join(F.broadcast(m), E.section_matches(F.col("full"), F.col("name"))).select(F.col("n_name").alias("section"), "name")


@query("g12_fisher_weights")
def g12(s, d):
    n = V.table(s, d, "customer").count()
    counts = V.counts(s, d)
    depth = counts.agg(F.sum("count")).first()[0] / n
    return N.fisher_weights(P.moments(counts, n), depth)


@query("g42_standardised_variance")
def g42(s, d):
    n, counts = V.table(s, d, "customer").count(), V.counts(s, d, fine=True)
    return N.standardised_variance(counts, P.moments(counts, n), n)


@query("g63_program_columns", sql(COUNTS, TOT, FACTOR, "w(program, feature, w) AS (VALUES ('p', 'Brand#11', 1.0), ('p', 'Brand#12', -0.5), ('q', 'Brand#12', 2.0), ('q', 'Brand#15', 2.0)), n AS (SELECT program, sum(abs(w)) AS n FROM w GROUP BY 1)", "SELECT cell, program, round(sum(w / n * ln(1 + count / f)), 7) AS response FROM counts JOIN factor USING (cell) JOIN w USING (feature) JOIN n USING (program) GROUP BY 1, 2"))
def g63(s, d):
    w = s.createDataFrame([("p", "Brand#11", 1.0), ("p", "Brand#12", -0.5), ("q", "Brand#12", 2.0), ("q", "Brand#15", 2.0)], "program string, feature string, w double")
    w = w.withColumn("w", F.col("w") / F.sum(F.abs("w")).over(W.partitionBy("program")))
    met = V.counts(s, d).join(F.broadcast(w), "feature").join(factors(s, d), "cell")
    return met.groupBy("cell", "program").agg(F.round(F.sum(F.col("w") * F.log1p(F.col("count") / F.col("size_factor"))), 7).alias("response"))


@query("g65_feature_averages", sql(CELLS, FINE, "f AS (SELECT DISTINCT feature, section FROM counts JOIN cells USING (cell)), m AS (SELECT feature, sum(n) AS mass FROM f JOIN (SELECT section, count(*) AS n FROM cells GROUP BY 1) USING (section) GROUP BY 1)", "SELECT feature, round(sum(count) / any_value(mass), 7) AS average FROM counts JOIN m USING (feature) GROUP BY 1"))
def g65(s, d):
    cells = V.cells(s, d).select("cell", F.col("section").alias("source"))
    counts = V.counts(s, d, fine=True)
    from ..sources import io

    mass = io.measured_mass(cells, io.coverage(counts.join(cells, "cell")))
    return counts.groupBy("feature").agg(F.sum("count").alias("s")).join(mass, "feature").select("feature", F.round(F.col("s") / F.col("mass"), 7).alias("average"))


@query("g70_donor_map", "WITH m(name, donor) AS (VALUES ('CHINA', 'd1'), ('STATES', 'd2'), ('UNITED_STATES', 'd3')), c AS (SELECT n_name, donor, name = replace(n_name, ' ', '_') AS exact, length(name) AS n FROM nation JOIN m ON replace(n_name, ' ', '_') = name OR ends_with(replace(n_name, ' ', '_'), '_' || name)) SELECT n_name AS section, coalesce(d, n_name) AS donor FROM nation LEFT JOIN (SELECT n_name, first(donor ORDER BY exact DESC, n DESC) AS d FROM c GROUP BY 1) USING (n_name)")
def g70(s, d):
    m = s.createDataFrame([("CHINA", "d1"), ("STATES", "d2"), ("UNITED_STATES", "d3")], "name string, donor string")
    n = V.table(s, d, "nation").select(F.col("n_name").alias("section"), F.regexp_replace("n_name", " ", "_").alias("full"))
    hit = n.join(F.broadcast(m), E.section_matches(F.col("full"), F.col("name"))).groupBy("section").agg(F.max(F.struct(F.col("full") == F.col("name"), F.length("name"), "donor"))["donor"].alias("d"))
    return n.join(hit, "section", "left").select("section", F.coalesce("d", "section").alias("donor"))


@query("g71_variance_explained", sql(CELLS, COUNTS, "y AS (SELECT cell, feature, count AS y FROM counts), z AS (SELECT cell, x / 1000 AS z FROM cells), w AS (SELECT feature, sum(y * z) / (SELECT sum(z * z) FROM z) AS w FROM y JOIN z USING (cell) GROUP BY 1)", "SELECT round((2 * (SELECT sum(y * z * w) FROM y JOIN z USING (cell) JOIN w USING (feature)) - (SELECT sum(w * w) FROM w) * (SELECT sum(z * z) FROM z)) / (SELECT sum(y * y) FROM y), 7) AS explained"))
def g71(s, d):
    z = V.cells(s, d).select("cell", (F.col("x") / 1000).alias("z"))
    zz = z.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    yz = V.counts(s, d).join(z, "cell").groupBy("feature").agg(F.sum(F.col("count") * F.col("z")).alias("yz"), F.sum(F.col("count") * F.col("count")).alias("yy"))
    w = F.col("yz") / zz
    return yz.agg(F.round((2 * F.sum(F.col("yz") * w) - F.sum(w * w) * zz) / F.sum("yy"), 7).alias("explained"))


@query("o1_ordered_edges", sql(CELLS, CONTACTS, "SELECT a, b, row_number() OVER (ORDER BY a, b) AS edge FROM contacts"))
def o1(s, d):
    return V.contacts(s, d).select("a", "b", F.row_number().over(W.orderBy("a", "b")).cast("long").alias("edge"))


@query("o4_heaviest_first")
def o4(s, d):
    sizes = [(r["feature"], r["total"]) for r in P.collected(P.totals(V.counts(s, d), "feature").orderBy("feature"), 10_000)]
    return s.createDataFrame(sorted(N.heaviest_first(sizes, 4).items()), "feature string, shard int")


@query("o5_axis_union", "SELECT p_brand AS feature FROM part WHERE p_size < 3 UNION SELECT p_brand FROM part WHERE p_size > 48")
def o5(s, d):
    p = V.table(s, d, "part")
    return p.filter("p_size < 3").select(F.col("p_brand").alias("feature")).union(p.filter("p_size > 48").select("p_brand")).dropDuplicates()


@query("m4_cascade")
def m4(s, d):
    """Communities of contacts between groups first; each contact starts from its groups' label."""
    cells = V.cells(s, d)
    group = cells.select("cell", (F.col("section") * 8 + F.pmod(F.floor(F.col("x") / 1500), F.lit(8))).cast("long").alias("group"))
    fine = _profiles(s, d)
    one = group.select(F.col("cell").alias("a"), F.col("group").alias("g1"))
    two = group.select(F.col("cell").alias("b"), F.col("group").alias("g2"))
    tagged = fine.join(one, "a").join(two, "b").withColumn("ga", F.least("g1", "g2")).withColumn("gb", F.greatest("g1", "g2"))
    flat = tagged.select("ga", "gb", F.explode(F.arrays_zip("cols", "vals")).alias("x")).groupBy("ga", "gb", F.col("x.cols").alias("dim")).agg(F.sum("x.vals").alias("value"))
    coarse = K.profiles(flat.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "dim", "value"))
    first = K.link_communities(coarse, 4, 25, gibbs=100, greedy=10, blocks=4, seed=3).select(F.col("a").alias("ga"), F.col("b").alias("gb"), "label")
    start = tagged.join(first, ["ga", "gb"]).select("a", "b", "label", "cols", "vals")
    return K.refine(start, 4, 25, gibbs=20, greedy=10, blocks=8, seed=4)


@query("m5_log_incidence")
def m5(s, d):
    contacts = cut(V.contacts(s, d))
    shares = cut(P.membership(V.communities(s, d, edges=contacts)))
    ends = G.both_ways(contacts)
    one = shares.select(F.col("cell").alias("src"), F.col("community").alias("k"), F.col("share").alias("p"))
    two = shares.select(F.col("cell").alias("dst"), F.col("community").alias("l"), F.col("share").alias("q"))
    met = ends.join(one, "src").join(two, "dst").groupBy("k", "l").agg(F.sum(F.col("p") * F.col("q")).alias("s"))
    return N.log_incidence(met)


@query("m19_propensity_recut", sql(*BASE, "SELECT cell, coalesce(first(community ORDER BY share DESC, community), 0) AS cluster, round(coalesce(max(share), 0), 9) AS top FROM cells LEFT JOIN shares USING (cell) GROUP BY 1"))
def m19(s, d):
    shares = P.membership(V.communities(s, d))
    top = shares.groupBy("cell").agg(F.max("share").alias("top"))
    return P.dominant(shares, V.cells(s, d)).join(top, "cell", "left").select("cell", "cluster", F.round(F.coalesce("top", F.lit(0.0)), 9).alias("top"))


def _loadings(s, d):
    _, table = _mixture(s, d)
    b = np.log1p(np.array([table[k] for k in sorted(table)]))
    b = b - b.mean(1, keepdims=True)
    return np.linalg.svd(b, full_matrices=False)[2][:3]


@query("m21_map_placement")
def m21(s, d):
    arrays, _ = _mixture(s, d)
    return arrays.mapInArrow(N.place(_loadings(s, d)), "cell long, latent array<double>, intercept double")


@query("m26_predict")
def m26(s, d):
    arrays, _ = _mixture(s, d)
    placed = arrays.mapInArrow(N.place(_loadings(s, d)), "cell long, latent array<double>, intercept double").select("cell", F.col("latent").alias("embedding"))
    kinds = V.cells(s, d).select("cell", F.pmod(F.xxhash64("kind"), F.lit(1000)).alias("label"))
    return latent.nearest_centroid(placed, latent.centroids(placed.join(kinds, "cell"), "label"))


@query("m30_design")
def m30(s, d):
    """Section dummies, smooth fields of two scales and depth splines of every receiver, one array each."""

    def each(key, t):
        import pyarrow as pa

        t = t.sort_by([("cell", "ascending")])
        x, y, depth = (t[c].to_numpy() for c in ("x", "y", "depth"))
        m = np.column_stack([X.fourier(x / 1000, y / 1000, 8.0, 4, 5), X.fourier(x / 1000, y / 1000, 32.0, 4, 5), X.depth_basis(depth)])
        return pa.table({"cell": t["cell"], "section": t["section"], "design": pa.array(m.tolist(), pa.list_(pa.float64()))})

    depth = P.totals(V.counts(s, d), "cell").select("cell", F.log1p("total").alias("depth"))
    return V.cells(s, d).select("cell", "section", "x", "y").join(depth, "cell").groupBy("section").applyInArrow(each, "cell long, section int, design array<double>")


@query("m38_sup_t_band")
def m38(s, d):
    t = V.cells(s, d).groupBy("section", "kind").agg(F.sum(F.col("x") / 1000).alias("v")).groupBy("section").pivot("kind").sum("v").na.fill(0.0).orderBy("section")
    v = np.array([r[1:] for r in P.collected(t, 10_000)], float)
    return s.createDataFrame([(X.sup_t(v, 2000, 1),)], "critical double")


@query("m39_sensitivity")
def m39(s, d):
    """The effect under growing sets of confounders."""
    rows = _receivers(s, d)
    out = None
    for name, columns in (("none", []), ("place", ["cx"]), ("place_donor", ["cx", "cd"])):
        base = rows.withColumn("one", F.lit(0.0)).select("pair", "cell", "fold", "treated", "y", "one", *columns)
        one = L.overlap_effect(X.cross_fit(base, ["one", *columns]), ["pair"]).withColumn("adjustment", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("m44_power_simulation")
def m44(s, d):
    """Planted effects on the tissue's own dose: rejections by effect size over keyed replicates."""
    rows = _receivers(s, d).select("cell", "fold", "treated", "cx", "cd")
    cases = rows.withColumn("effect", F.explode(F.array(F.lit(0.0), F.lit(0.5)))).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(4))))
    u, v = (E.keyed_uniform(k, F.col("cell"), F.col("effect"), F.col("rep")) for k in (31, 32))
    noise = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
    cases = cases.select(F.concat_ws("|", "effect", "rep").alias("pair"), "cell", "fold", "treated", (F.col("cx") / 5000 + F.col("effect") * F.col("treated") + noise).alias("y"), "cx", "cd")
    fitted = X.cross_fit(cases, ["cx", "cd"]).join(V.cells(s, d).select("cell", "section"), "cell")
    e = F.col("e")
    h = e * (1 - e)
    num = F.when(F.col("treated") == 1, h * (F.col("m1") - F.col("m0")) + (1 - e) * (F.col("y") - F.col("m1"))).otherwise(h * (F.col("m1") - F.col("m0")) - e * (F.col("y") - F.col("m0")))
    est = L.tile_jackknife(fitted.withColumn("h", h).withColumn("num", num), ["pair"], "section", "num", "h")
    return est.groupBy(F.split("pair", r"\|")[0].cast("double").alias("effect")).agg(F.avg((F.abs(F.col("theta") / F.col("se")) > 2.064).cast("int")).alias("rejected"), F.avg("theta").alias("theta"))


@query("m48_single_cell_baseline")
def m48(s, d):
    """Log-normalised, scaled and clipped features, principal components, k-means by cosine."""
    values = cut(P.normalised(V.counts(s, d)))
    return K.spherical_kmeans(cut(integrate.components(values, V.cells(s, d), 5)), 5, 5, 2)


@query("m49_domain_segmentation")
def m49(s, d):
    start = V.cells(s, d).select("cell", F.pmod(F.xxhash64("kind"), F.lit(3)).cast("int").alias("label"))
    return N.segment(V.contacts(s, d), V.counts(s, d), start, 1.0, 3)


@query("m51_spatial_smoothing")
def m51(s, d):
    return N.smoothed(V.contacts(s, d), P.normalised(V.counts(s, d)).filter("feature = 'Brand#11'"), 0.5, 5)


@query("m54_pearson_residuals", sql(COUNTS, "t AS (SELECT sum(count) AS t FROM counts), c AS (SELECT cell, sum(count) AS ct FROM counts GROUP BY 1), f AS (SELECT feature, sum(count) AS ft FROM counts GROUP BY 1)", "SELECT cell, feature, round((count - ct * ft / t) / sqrt(ct * ft / t + power(ct * ft / t, 2) / 100), 6) AS residual FROM counts JOIN c USING (cell) JOIN f USING (feature), t"))
def m54(s, d):
    """Regularised negative-binomial residuals of the observed counts, with dispersion 100."""
    c = V.counts(s, d)
    mu = F.sum("count").over(W.partitionBy("cell")) * F.col("ft") / F.col("t")
    f = P.totals(c, "feature").withColumnRenamed("total", "ft").withColumn("t", F.sum("ft").over(W.partitionBy()))
    met = c.join(F.broadcast(f), "feature").withColumn("mu", mu)
    return met.select("cell", "feature", F.round((F.col("count") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / 100), 6).alias("residual"))


@query("m55_super_cells", sql(CELLS, COUNTS, "g AS (SELECT cell, section * 100 + CAST(floor((x + 1000) / 500) AS BIGINT) AS pb FROM cells)", "SELECT pb, feature, sum(count) AS count, count(DISTINCT cell) AS cells FROM counts JOIN g USING (cell) GROUP BY 1, 2"))
def m55(s, d):
    g = V.cells(s, d).select("cell", (F.col("section") * 100 + F.floor((F.col("x") + 1000) / 500)).alias("pb"))
    return V.counts(s, d).join(g, "cell").groupBy("pb", "feature").agg(F.sum("count").alias("count"), F.countDistinct("cell").alias("cells"))


@query("m57_producer_calibration")
def m57(s, d):
    n = V.cells(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    c = V.counts(s, d).filter("feature = 'Brand#23'").join(V.cells(s, d).select("cell", "kind"), "cell").groupBy("kind").agg(F.sum("count").alias("s"), F.count(F.when(F.col("count") > 0, 1)).alias("k"))
    rows = P.collected(n.join(c, "kind"), 10_000)
    return s.createDataFrame([(r["kind"], *N.zip_by_moments(r["s"] / r["n"], r["k"] / r["n"])) for r in rows], "kind string, p double, rate double")


@query("m59_batch_profiles", sql(CELLS, COUNTS, "p AS (SELECT section, feature, sum(count) / sum(sum(count)) OVER (PARTITION BY section) AS q FROM counts JOIN cells USING (cell) GROUP BY 1, 2)", "SELECT section, round(sum(q) FILTER (feature < 'Brand#31'), 9) AS fit_mass, round(sum(q) FILTER (feature >= 'Brand#31'), 9) AS scored_mass FROM p GROUP BY 1"))
def m59(s, d):
    c = V.counts(s, d).join(V.cells(s, d).select("cell", "section"), "cell").groupBy("section", "feature").agg(F.sum("count").alias("c"))
    q = c.withColumn("q", F.col("c") / F.sum("c").over(W.partitionBy("section")))
    return q.groupBy("section").agg(F.round(F.sum(F.when(F.col("feature") < "Brand#31", F.col("q"))), 9).alias("fit_mass"), F.round(F.sum(F.when(F.col("feature") >= "Brand#31", F.col("q"))), 9).alias("scored_mass"))


@query("m62_bandwidth")
def m62(s, d):
    """Silverman's rule per section, each an Arrow group."""

    def each(key, t):
        import pyarrow as pa

        return pa.table({"section": pa.array([key[0].as_py()], pa.int32()), "bandwidth": pa.array([N.silverman(t["x"].to_numpy())])})

    return V.cells(s, d).select("section", "x").groupBy("section").applyInArrow(each, "section int, bandwidth double")


@query("sim_truth_scores")
def sim_truth(s, d):
    """The simulator's planted domains found again from its counts, scored by adjusted Rand index."""
    sim = X.simulate(s, 2, 150, 24, 3, 4.0, 7)
    spot = sim.select((F.col("section") * 1000 + F.col("spot")).cast("long").alias("cell"), "domain", "gene", "count")
    best = spot.withColumn("block", F.floor(F.col("gene") / 8).cast("int")).groupBy("cell", "domain", "block").agg(F.sum("count").alias("c"))
    found = best.groupBy("cell", "domain").agg(F.max(F.struct("c", "block"))["block"].alias("b"))
    return C.ari(found.select(F.col("domain").alias("a"), "b"))
