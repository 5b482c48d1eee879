"""Ligand-receptor queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import graph as G
from ..operators import lra as L
from ..operators import pool as P
from ..operators import stats as S
from ..sources import views as V
from ..sources.views import BOTH, CELLS, COMMUNITIES, CONTACTS, COUNTS, FINE, PAIRS, sql
from .count_queries import TOT
from .registry import query

BASE = (CELLS, COUNTS, CONTACTS, COMMUNITIES)
STRATA = """votes AS (SELECT cell, community, count(*) AS n FROM (SELECT a AS cell, community FROM communities UNION ALL SELECT b, community FROM communities) GROUP BY 1, 2),
modes AS (SELECT cell, first(community ORDER BY n DESC, community) AS c FROM votes GROUP BY 1),
strata AS (SELECT a, b, p.c AS community FROM contacts JOIN modes p ON a = p.cell JOIN modes q ON b = q.cell WHERE p.c = q.c)"""


@query("m42_strata", sql(*BASE, STRATA, "SELECT a, b, community FROM strata"))
def m42(s, d):
    return L.strata(V.communities(s, d))


FACTS = """has AS (SELECT cell, feature FROM counts WHERE count > 0),
facts AS (SELECT community, ligand, receptor, a, b, la.cell IS NOT NULL AS l_a, ra.cell IS NOT NULL AS r_a, lb.cell IS NOT NULL AS l_b, rb.cell IS NOT NULL AS r_b
  FROM strata, pairs LEFT JOIN has la ON la.cell = a AND la.feature = ligand LEFT JOIN has ra ON ra.cell = a AND ra.feature = receptor LEFT JOIN has lb ON lb.cell = b AND lb.feature = ligand LEFT JOIN has rb ON rb.cell = b AND rb.feature = receptor)"""
TABLE = """tab AS (SELECT community, ligand, receptor, count(*) AS n_edges, 2 * count(*) AS n, sum(l_a::INT + l_b::INT) AS n_l, sum(r_a::INT + r_b::INT) AS n_r,
    sum((l_a AND r_b)::INT + (l_b AND r_a)::INT) AS n11, count(*) FILTER (l_a AND r_b AND l_b AND r_a) AS n_mutual, count(*) FILTER ((l_a AND r_b) <> (l_b AND r_a)) AS n_oneway FROM facts GROUP BY 1, 2, 3),
role AS (SELECT community, ligand, receptor, cell, sum(sent::INT) AS s, sum(got::INT) AS r FROM (SELECT community, ligand, receptor, a AS cell, l_a AND r_b AS sent, l_b AND r_a AS got FROM facts UNION ALL SELECT community, ligand, receptor, b, l_b AND r_a, l_a AND r_b FROM facts) WHERE sent OR got GROUP BY 1, 2, 3, 4),
pure AS (SELECT community, ligand, receptor, avg(abs(s - r) / (s + r)) AS role_purity FROM role GROUP BY 1, 2, 3),
deep AS (SELECT community, avg(ln(1 + total)) AS mean_log_depth FROM (SELECT DISTINCT community, cell FROM (SELECT community, a AS cell FROM strata UNION ALL SELECT community, b FROM strata)) JOIN tot USING (cell) GROUP BY 1)"""
SCORES = """SELECT community, ligand, receptor, n_edges, round(mean_log_depth, 7) AS mean_log_depth, round(n_l / n, 9) AS lig_rate, round(n_r / n, 9) AS rec_rate, n_mutual, n_oneway, round(coalesce(role_purity, 'NaN'::DOUBLE), 7) AS role_purity,
  round(CASE WHEN n11 = 0 AND 2 * n_l * n_r < n THEN 'NaN'::DOUBLE ELSE ln(n11 + 0.5) + ln(n - n_l - n_r + n11 + 0.5) - ln(n_l - n11 + 0.5) - ln(n_r - n11 + 0.5) END, 7) AS log_or,
  round(CASE WHEN n11 = 0 AND 2 * n_l * n_r < n THEN 'NaN'::DOUBLE ELSE sqrt(2 * (1 / (n11 + 0.5) + 1 / (n_l - n11 + 0.5) + 1 / (n_r - n11 + 0.5) + 1 / (n - n_l - n_r + n11 + 0.5))) END, 7) AS log_or_se
FROM tab JOIN deep USING (community) LEFT JOIN pure USING (community, ligand, receptor)"""


def depth(s, d):
    return P.totals(V.counts(s, d), "cell").select("cell", F.log1p("total").alias("depth"))


@query("coexpression_scores", sql(*BASE, STRATA, PAIRS, TOT, FACTS, TABLE, SCORES))
def coexpression_scores(s, d):
    out = L.coexpression_scores(L.strata(V.communities(s, d)), V.counts(s, d), V.pairs(s), depth(s, d))
    nine, seven = ("lig_rate", "rec_rate"), ("mean_log_depth", "role_purity", "log_or", "log_or_se")
    return out.withColumns({c: F.round(c, 9) for c in nine} | {c: F.round(c, 7) for c in seven})


@query("p22_contact_classes", sql(*BASE, STRATA, PAIRS, FACTS, "SELECT ligand, receptor, CASE WHEN l_a AND r_b AND l_b AND r_a THEN 'mutual' WHEN (l_a AND r_b) OR (l_b AND r_a) THEN 'oneway' ELSE 'silent' END AS kind, count(*) AS n FROM facts WHERE l_a OR r_a OR l_b OR r_b GROUP BY 1, 2, 3"))
def p22(s, d):
    f = L.detected(L.strata(V.communities(s, d)), V.counts(s, d), V.pairs(s))
    kind = E.classify_contact(*[F.col(c) for c in ("l_a", "r_a", "l_b", "r_b")])
    return f.groupBy("ligand", "receptor", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


FACTOR = "med AS (SELECT list_sort(list(greatest(total, 1)))[count(*) // 2 + 1] AS med FROM tot), factor AS (SELECT cell, greatest(total, 1) / greatest(med, 1) AS f FROM tot, med)"


def factors(s, d):
    t = P.totals(V.counts(s, d), "cell").withColumn("depth", F.greatest(F.col("total"), F.lit(1.0)))
    return t.join(F.broadcast(S.upper_median_by(t, [], "depth", "med"))).select("cell", (F.col("depth") / F.greatest(F.col("med"), F.lit(1.0))).alias("size_factor"))


DOSE = "dose AS (SELECT src AS cell, sum(coalesce(count / f, 0)) AS dose FROM ends LEFT JOIN (SELECT cell, count / f AS cf, count, f FROM counts JOIN factor USING (cell) WHERE feature = 'Brand#23') c ON c.cell = dst GROUP BY 1)"


@query("g30_contact_dose", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, DOSE, "SELECT cell, round(dose, 6) AS dose FROM dose"))
def g30(s, d):
    return L.contact_dose(V.contacts(s, d), V.counts(s, d), "Brand#23", factors(s, d)).withColumn("dose", F.round("dose", 6))


def dose(s, d):
    return L.contact_dose(V.contacts(s, d), V.counts(s, d), "Brand#23", factors(s, d))


@query("p15_exposed", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, DOSE, "SELECT cell, dose > 40 AS exposed FROM dose"))
def p15(s, d):
    return dose(s, d).select("cell", (F.col("dose") > 40).alias("exposed"))


@query("p16_threshold", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, DOSE, "m AS (SELECT list_sort(list(dose))[count(*) // 2 + 1] AS m, count(*) FILTER (dose > 0) AS above, count(*) AS n FROM dose)", "SELECT round(CASE WHEN any_value(above) >= 20 AND any_value(n) - any_value(above) >= 20 THEN 0 WHEN count(*) FILTER (dose > m) >= 20 THEN any_value(m) ELSE coalesce(max(dose) FILTER (dose < m), 0) END, 6) AS tau FROM dose, m"))
def p16(s, d):
    return L.choose_threshold(dose(s, d), 20).select(F.round("tau", 6).alias("tau"))


@query("g29_eta_squared", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, DOSE, "g AS (SELECT kind, count(*) AS n, sum(dose) AS s, sum(dose * dose) AS q FROM dose JOIN cells USING (cell) GROUP BY 1)", "SELECT round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM g"))
def g29(s, d):
    met = dose(s, d).join(V.cells(s, d).select("cell", "kind"), "cell").withColumn("one", F.lit(1))
    return S.eta_squared(met, ["one"], "kind", "dose").select(F.round("eta2", 6).alias("eta2"))


@query("g27_weighted_covariance", sql(CELLS, COUNTS, CONTACTS, "v AS (SELECT a, b, 1 / (1 + distance) AS w, coalesce(l.count, 0) AS l, coalesce(r.count, 0) AS r, section FROM contacts LEFT JOIN (FROM counts WHERE feature = 'Brand#11') l ON l.cell = a LEFT JOIN (FROM counts WHERE feature = 'Brand#12') r ON r.cell = b)", "SELECT section, round(sum(w * l * r) / sum(w) - sum(w * l) / sum(w) * sum(w * r) / sum(w), 5) AS cov FROM v GROUP BY 1"))
def g27(s, d):
    c = V.counts(s, d)
    l = c.filter("feature = 'Brand#11'").select(F.col("cell").alias("a"), F.col("count").alias("l"))
    r = c.filter("feature = 'Brand#12'").select(F.col("cell").alias("b"), F.col("count").alias("r"))
    met = V.contacts(s, d).join(l, "a", "left").join(r, "b", "left").na.fill(0.0, ["l", "r"]).withColumn("w", 1 / (1 + F.col("distance")))
    return S.weighted_cov(met, ["section"], "l", "r", "w").withColumn("cov", F.round("cov", 5))


@query("g28_restandardised", sql(CELLS, COUNTS, TOT, "m AS (SELECT section, list_sort(list(total))[count(*) // 2 + 1] AS med FROM tot JOIN cells USING (cell) GROUP BY 1), v AS (SELECT cell, section, total - med AS dev FROM tot JOIN cells USING (cell) JOIN m USING (section)), q AS (SELECT section, list_sort(list(abs(dev)))[count(*) // 2 + 1] AS mad FROM v GROUP BY 1)", "SELECT cell, round(dev / greatest(mad * 1.4826, 0.5), 6) AS z FROM v JOIN q USING (section)"))
def g28(s, d):
    t = P.totals(V.counts(s, d), "cell").join(V.cells(s, d).select("cell", "section"), "cell")
    return S.restandardise(t, ["section"], "total", "z", 0.5).select("cell", F.round("z", 6).alias("z"))


@query("g31_competence", sql(CELLS, COUNTS, "r AS (SELECT kind, avg((coalesce(count, 0) > 0)::INT) AS share FROM cells LEFT JOIN (FROM counts WHERE feature = 'Brand#23') USING (cell) GROUP BY 1)", "SELECT kind, t AS threshold, share >= t AS competent FROM r, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) v(t)"))
def g31(s, d):
    c = V.cells(s, d).join(V.counts(s, d).filter("feature = 'Brand#23'"), "cell", "left")
    r = c.groupBy("kind").agg(F.avg((F.coalesce("count", F.lit(0.0)) > 0).cast("int")).alias("share"))
    return r.select("kind", "share", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2)])).alias("threshold")).select("kind", "threshold", (F.col("share") >= F.col("threshold")).alias("competent"))


@query("g32_response_score", sql(COUNTS, TOT, FACTOR, "w(feature, w) AS (VALUES ('Brand#11', 1.0), ('Brand#12', -0.5), ('Brand#13', 2.0))", "SELECT cell, round(sum(coalesce(w, 0) * ln(1 + count / f)) / 3.5, 7) AS score FROM counts JOIN factor USING (cell) JOIN w USING (feature) GROUP BY 1"))
def g32(s, d):
    w = s.createDataFrame([("Brand#11", 1.0), ("Brand#12", -0.5), ("Brand#13", 2.0)], "feature string, w double")
    met = V.counts(s, d).join(F.broadcast(w), "feature").join(factors(s, d), "cell")
    return met.groupBy("cell").agg(F.round(F.sum(F.col("w") * F.log1p(F.col("count") / F.col("size_factor"))) / 3.5, 7).alias("score"))


XY = "xy AS (SELECT cell, coalesce(l.count, 0) AS x, coalesce(r.count, 0) AS y FROM cells LEFT JOIN (FROM counts WHERE feature = 'Brand#11') l USING (cell) LEFT JOIN (FROM counts WHERE feature = 'Brand#12') r USING (cell)), z AS (SELECT cell, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS zx, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS zy FROM xy)"


def xy(s, d):
    c = V.counts(s, d)
    l = c.filter("feature = 'Brand#11'").select("cell", F.col("count").alias("x"))
    r = c.filter("feature = 'Brand#12'").select("cell", F.col("count").alias("y"))
    return V.cells(s, d).select("cell", "section", "kind").join(l, "cell", "left").join(r, "cell", "left").na.fill(0.0, ["x", "y"])


@query("g35_bivariate_moran", sql(CELLS, COUNTS, CONTACTS, BOTH, XY, "lag AS (SELECT src AS cell, avg(zy) AS lag FROM ends JOIN z ON z.cell = dst GROUP BY 1)", "SELECT round(avg(zx * lag), 7) AS moran FROM z JOIN lag USING (cell)"))
def g35(s, d):
    return L.bivariate_moran(V.contacts(s, d), xy(s, d)).select(F.round("moran", 7).alias("moran"))


@query("g34_coexpression_scope", sql(CELLS, COUNTS, CONTACTS, BOTH, "v AS (SELECT k.kind, coalesce(l.count, 0) AS l, coalesce(r.count, 0) AS r FROM ends JOIN cells k ON k.cell = src JOIN cells m ON m.cell = dst AND m.kind = k.kind LEFT JOIN (FROM counts WHERE feature = 'Brand#11') l ON l.cell = src LEFT JOIN (FROM counts WHERE feature = 'Brand#12') r ON r.cell = dst)", "SELECT kind, round(avg(l * r) - avg(l) * avg(r), 5) AS cov FROM v GROUP BY 1"))
def g34(s, d):
    v = xy(s, d)
    met = G.both_ways(V.contacts(s, d)).join(v.select(F.col("cell").alias("src"), F.col("kind").alias("kind"), F.col("x").alias("l")), "src").join(v.select(F.col("cell").alias("dst"), F.col("kind").alias("k2"), F.col("y").alias("r")), "dst").filter("kind = k2")
    return met.groupBy("kind").agg(F.round(F.avg(F.col("l") * F.col("r")) - F.avg("l") * F.avg("r"), 5).alias("cov"))


@query("g36_celltype_scores", sql(CELLS, COUNTS, PAIRS, "n AS (SELECT kind, count(*) AS n FROM cells GROUP BY 1), m AS (SELECT kind, feature, sum(count) / any_value(n) AS mean FROM counts JOIN cells USING (cell) JOIN n USING (kind) GROUP BY 1, 2 HAVING count(*) FILTER (count > 0) / any_value(n) >= 0.1)", "SELECT ligand, receptor, p.kind AS sender, q.kind AS receiver, round(p.mean * q.mean, 5) AS score FROM pairs JOIN m p ON p.feature = ligand JOIN m q ON q.feature = receptor"))
def g36(s, d):
    return L.celltype_scores(V.cells(s, d).select("cell", "kind"), V.counts(s, d), V.pairs(s)).withColumn("score", F.round("score", 5))


@query("g37_moran", sql(CELLS, COUNTS, CONTACTS, BOTH, "n AS (SELECT count(*) AS n FROM cells), w AS (SELECT count(*) AS w FROM ends), f AS (SELECT DISTINCT feature FROM counts), v AS (SELECT cell, feature, coalesce(count, 0) AS v FROM cells CROSS JOIN f LEFT JOIN counts USING (cell, feature)), z AS (SELECT cell, feature, v - avg(v) OVER (PARTITION BY feature) AS z FROM v)", "SELECT feature, round(any_value(n) / any_value(w) * any_value(num) / sum(z * z), 7) AS moran FROM z JOIN (SELECT p.feature, sum(p.z * q.z) AS num FROM ends JOIN z p ON p.cell = src JOIN z q ON q.cell = dst AND q.feature = p.feature GROUP BY 1) USING (feature), n, w GROUP BY 1"))
def g37(s, d):
    n = V.table(s, d, "customer").count()
    return L.moran_by_feature(V.contacts(s, d), V.counts(s, d).select("cell", "feature", F.col("count").alias("value")), n).withColumn("moran", F.round("moran", 7))


@query("g38_marginal_association", sql(CELLS, COUNTS, XY, "SELECT round(corr(x, y), 7) AS r, round(avg(y) FILTER (x > 10) - avg(y) FILTER (x <= 10), 6) AS contrast FROM xy"))
def g38(s, d):
    return xy(s, d).agg(F.round(F.corr("x", "y"), 7).alias("r"), F.round(F.avg(F.when(F.col("x") > 10, F.col("y"))) - F.avg(F.when(F.col("x") <= 10, F.col("y"))), 6).alias("contrast"))


@query("g39_clustered_sd", sql(CELLS, COUNTS, XY, "t AS (SELECT kind, section, sum(xy.x - 10) AS s FROM xy JOIN cells USING (cell) GROUP BY 1, 2)", "SELECT kind, round(sqrt(sum(s * s) * CASE WHEN count(*) FILTER (s <> 0) > 1 THEN count(*) FILTER (s <> 0) / (count(*) FILTER (s <> 0) - 1) ELSE 1 END), 5) AS sd, CASE WHEN count(*) FILTER (s <> 0) > 1 THEN round(greatest(2, least(count(*) FILTER (s <> 0), 3 * sum(s * s) * sum(s * s) / sum(power(s, 4)))), 5) ELSE 'NaN'::DOUBLE END AS effective FROM t GROUP BY 1"))
def g39(s, d):
    out = S.clustered(xy(s, d).withColumn("v", F.col("x") - 10), ["kind"], "section", "v")
    return out.select("kind", F.round("sd", 5).alias("sd"), F.round("effective", 5).alias("effective"))


@query("g40_jackknife_se", sql(CELLS, "SELECT kind, round(sqrt((count(*) - 1) / count(*) * var_pop(x) * count(*)), 5) AS se FROM cells GROUP BY 1"))
def g40(s, d):
    return S.jackknife_se(V.cells(s, d), ["kind"], "x").withColumn("se", F.round("se", 5))


TESTS = "t AS (SELECT p_partkey AS id, p_size % 4 AS fam, p_brand AS ligand, CASE WHEN p_partkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE ('0x' || substr(md5('3:' || p_partkey), 1, 8))::BIGINT / 4294967296.0 END AS p FROM part)"


def tests(s, d):
    p = F.when(F.col("p_partkey") % 11 == 0, F.lit(float("nan"))).otherwise(E.keyed_uniform(3, F.col("p_partkey")))
    return V.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("fam"), F.col("p_brand").alias("ligand"), p.alias("p"))


BHQ = "s AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p) AS s FROM t WHERE NOT isnan(p)), q AS (SELECT id, fam, ligand, p, least(1, min(s) OVER (PARTITION BY fam ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM s)"


@query("w1_benjamini_hochberg", sql(TESTS, BHQ, "SELECT id, round(q, 9) AS q FROM q UNION ALL SELECT id, 'NaN'::DOUBLE FROM t WHERE isnan(p)"))
def w1(s, d):
    return S.bh(tests(s, d), ["fam"], "p", "q").select("id", F.round("q", 9).alias("q"))


@query("w2_simes", sql(TESTS, "s AS (SELECT *, p * count(*) OVER (PARTITION BY fam, ligand) / row_number() OVER (PARTITION BY fam, ligand ORDER BY p) AS s FROM t WHERE NOT isnan(p)), l AS (SELECT fam, ligand, least(1, min(s)) AS p FROM s GROUP BY 1, 2), b AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p) AS s FROM l)", "SELECT fam, ligand, round(p, 9) AS p, round(least(1, min(s) OVER (PARTITION BY fam ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM b UNION ALL SELECT fam, ligand, 'NaN'::DOUBLE, 'NaN'::DOUBLE FROM t GROUP BY 1, 2 HAVING count(*) FILTER (NOT isnan(p)) = 0"))
def w2(s, d):
    l = S.simes(tests(s, d), ["fam", "ligand"], "p", "p")
    return S.bh(l, ["fam"], "p", "q").select("fam", "ligand", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("w3_benjamini_yekutieli", sql(TESTS, BHQ, "h AS (SELECT fam, list_sum([1.0 / i FOR i IN range(1, n + 1)]) AS h FROM (SELECT fam, count(*) AS n FROM q GROUP BY 1))", "SELECT id, round(least(1, q * h), 8) AS q FROM q JOIN h USING (fam) UNION ALL SELECT id, 'NaN'::DOUBLE FROM t WHERE isnan(p)"))
def w3(s, d):
    return S.by_adjust(tests(s, d), ["fam"], "p", "q").select("id", F.round("q", 8).alias("q"))


@query("w4_control_q", sql(TESTS, BHQ, "c AS (SELECT id, fam, ('0x' || substr(md5('4:' || id), 1, 8))::BIGINT / 4294967296.0 AS c FROM q WHERE q < 0.98), z AS (SELECT *, c * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY c) AS s FROM c), r AS (SELECT id, least(1, min(s) OVER (PARTITION BY fam ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS control_q FROM z)", "SELECT t.id, round(coalesce(control_q, 'NaN'::DOUBLE), 8) AS control_q FROM t LEFT JOIN r USING (id)"))
def w4(s, d):
    q = S.bh(tests(s, d), ["fam"], "p", "q")
    c = q.withColumn("c", F.when((F.col("q") < 0.98) & ~F.isnan("q"), E.keyed_uniform(4, F.col("id"))).otherwise(F.lit(float("nan"))))
    return S.bh(c, ["fam"], "c", "control_q").select("id", F.round("control_q", 8).alias("control_q"))


VERDICT = "e AS (SELECT p_partkey AS id, p_size % 7 <> 0 AS estimable, p_size % 5 = 0 AS confounded, p_size % 3 = 0 AS control_failed, p_retailprice > 1000 AS coexpressed, p_partkey % 2 = 0 AS effect FROM part)"


def evidence(s, d):
    p = V.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 != 0).alias("estimable"), (F.col("p_size") % 5 == 0).alias("confounded"), (F.col("p_size") % 3 == 0).alias("control_failed"), (F.col("p_retailprice") > 1000).alias("coexpressed"), (F.col("p_partkey") % 2 == 0).alias("effect"))


_CASE = "CASE WHEN NOT estimable THEN 'insufficient_data' WHEN confounded THEN 'celltype_inseparable' WHEN control_failed AND effect THEN 'control_failed' WHEN coexpressed AND effect THEN 'supported' WHEN coexpressed THEN 'colocation_only' WHEN effect THEN 'effect_without_coexpression' ELSE 'no_evidence' END"


@query("p21_verdict", sql(VERDICT, f"SELECT id, {_CASE} AS verdict FROM e"))
def p21(s, d):
    return evidence(s, d).select("id", E.verdict(*[F.col(c) for c in ("estimable", "confounded", "control_failed", "coexpressed", "effect")]).alias("verdict"))


@query("g55_verdict_counts", sql(VERDICT, f"SELECT {_CASE} AS verdict, count(*) AS n FROM e GROUP BY 1"))
def g55(s, d):
    return p21(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("p24_verdict_filter", sql(VERDICT, f"v AS (SELECT id, {_CASE} AS verdict, CASE WHEN id % 9 = 0 THEN 'NaN'::DOUBLE ELSE id % 100 / 100.0 END AS p FROM e)", "SELECT id, p, row_number() OVER (ORDER BY isnan(p), p, id) AS place FROM v WHERE verdict IN ('supported', 'no_evidence')"))
def p24(s, d):
    p = F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 100 / 100.0)
    v = p21(s, d).withColumn("p", p).filter("verdict IN ('supported', 'no_evidence')")
    return v.select("id", "p", F.row_number().over(W.orderBy(F.isnan("p"), "p", "id")).cast("long").alias("place"))


ROWS = "r AS (SELECT cell, section, kind, donor, (x > 4000)::INT AS treated, 0.2 + 0.6 * (section / 25.0) AS e, x / 10000 AS m0, x / 10000 + 0.1 AS m1, y / 1000 AS y FROM cells), h AS (SELECT *, e * (1 - e) AS h, CASE WHEN treated = 1 THEN e * (1 - e) * (m1 - m0) + (1 - e) * (y - m1) ELSE e * (1 - e) * (m1 - m0) - e * (y - m0) END AS num FROM r)"


def effect_rows(s, d):
    e = 0.2 + 0.6 * (F.col("section") / 25.0)
    return V.cells(s, d).select("cell", "section", "kind", "donor", (F.col("x") > 4000).cast("int").alias("treated"), e.alias("e"), (F.col("x") / 10000).alias("m0"), (F.col("x") / 10000 + 0.1).alias("m1"), (F.col("y") / 1000).alias("y"))


@query("m34_overlap_effect", sql(CELLS, ROWS, "SELECT kind, round(sum(num) / sum(h), 7) AS theta, count(*) AS n, CAST(sum(treated) AS BIGINT) AS n_treated, round(avg(h), 8) AS mean_h, round(sum(h) * sum(h) / sum(h * h), 5) AS ess FROM h GROUP BY 1"))
def m34(s, d):
    out = L.overlap_effect(effect_rows(s, d), ["kind"])
    return out.select("kind", F.round("theta", 7).alias("theta"), "n", "n_treated", F.round("mean_h", 8).alias("mean_h"), F.round("ess", 5).alias("ess"))


@query("g66_near_determined", sql(CELLS, ROWS, "SELECT kind, round(avg((h < 0.19)::INT), 9) AS share FROM h GROUP BY 1"))
def g66(s, d):
    h = F.col("e") * (1 - F.col("e"))
    return effect_rows(s, d).groupBy("kind").agg(F.round(F.avg((h < 0.19).cast("int")), 9).alias("share"))


@query("m37_tile_jackknife", sql(CELLS, ROWS, "t AS (SELECT kind, section, sum(num) AS tn, sum(h) AS td FROM h GROUP BY 1, 2), v AS (SELECT kind, sum(tn) OVER w AS n, sum(td) OVER w AS d, (sum(tn) OVER w - tn) / (sum(td) OVER w - td) AS v FROM t WINDOW w AS (PARTITION BY kind))", "SELECT kind, round(any_value(n / d), 7) AS theta, round(sqrt((count(*) - 1) * var_pop(v)), 7) AS se FROM v GROUP BY 1"))
def m37(s, d):
    e, m0, m1, y = (F.col(c) for c in ("e", "m0", "m1", "y"))
    h = e * (1 - e)
    num = F.when(F.col("treated") == 1, h * (m1 - m0) + (1 - e) * (y - m1)).otherwise(h * (m1 - m0) - e * (y - m0))
    out = L.tile_jackknife(effect_rows(s, d).withColumn("h", h).withColumn("num", num), ["kind"], "section", "num", "h")
    return out.select("kind", F.round("theta", 7).alias("theta"), F.round("se", 7).alias("se"))


ESTIMATES = "e AS (SELECT p_brand AS pair, p_retailprice / 1000 AS theta, 0.05 + (p_partkey % 17) / 50.0 AS se, 10.0 + p_size AS df FROM part)"


def estimates(s, d):
    return V.table(s, d, "part").select(F.col("p_brand").alias("pair"), (F.col("p_retailprice") / 1000).alias("theta"), (0.05 + (F.col("p_partkey") % 17) / 50.0).alias("se"), (10.0 + F.col("p_size")).alias("df"))


@query("m35_rubin", sql(ESTIMATES, "g AS (SELECT pair, count(*) AS r, avg(theta) AS theta, avg(se * se) AS u, var_samp(theta) AS b, min(df) AS nu FROM e GROUP BY 1), t AS (SELECT *, u + (1 + 1 / r) * b AS t, (1 + 1 / r) * b / (u + (1 + 1 / r) * b) AS lam FROM g)", "SELECT pair, round(theta, 7) AS theta, round(sqrt(t), 7) AS se, round(CASE WHEN r < 2 THEN nu WHEN lam > 0 THEN 1 / (lam * lam / (r - 1) + 1 / ((nu + 1) / (nu + 3) * nu * (1 - lam))) ELSE (nu + 1) / (nu + 3) * nu END, 5) AS df FROM t"))
def m35(s, d):
    out = L.rubin(estimates(s, d), ["pair"])
    return out.select("pair", F.round("theta", 7).alias("theta"), F.round("se", 7).alias("se"), F.round("df", 5).alias("df"))


@query("m36_abf_average", sql(ESTIMATES, "m AS (SELECT pair, list_sort(list(se * se))[count(*) // 2 + 1] AS vm FROM e GROUP BY 1), l AS (SELECT *, se * se AS v, (100 * vm) / (se * se + 100 * vm) AS r FROM e JOIN m USING (pair)), b AS (SELECT *, 0.5 * ln(1 - r) + 0.5 * theta * theta / v * r AS lbf FROM l), x AS (SELECT *, exp(lbf - max(lbf) OVER (PARTITION BY pair)) AS w0 FROM b), w AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY pair) AS w FROM x), a AS (SELECT *, sum(w * theta) OVER (PARTITION BY pair) AS mean FROM w)", "SELECT pair, round(any_value(mean), 6) AS theta, round(sqrt(sum(w * (v + (theta - mean) * (theta - mean)))), 6) AS se, round(1 / sum(w / df), 5) AS df FROM a GROUP BY 1"))
def m36(s, d):
    out = L.abf_average(estimates(s, d), ["pair"])
    return out.select("pair", F.round("theta", 6).alias("theta"), F.round("se", 6).alias("se"), F.round("df", 5).alias("df"))


@query("m29_spatial_folds", sql(CELLS, "t AS (SELECT cell, section, CAST(floor(x / 900) AS BIGINT) AS tx, CAST(floor(y / 400) AS BIGINT) AS ty FROM cells)", "SELECT cell, CAST(('0x' || substr(md5('11:' || section || ':' || tx || ':' || ty), 1, 8))::BIGINT % 5 AS INT) AS fold FROM t"))
def m29(s, d):
    t = V.cells(s, d).select("cell", F.concat_ws(":", F.lit("11"), "section", F.floor(F.col("x") / 900), F.floor(F.col("y") / 400)).alias("k"))
    return t.select("cell", (F.conv(F.substring(F.md5("k"), 1, 8), 16, 10).cast("long") % 5).cast("int").alias("fold"))


@query("w12_interleaved", "SELECT p_partkey AS id, r IN (SELECT CAST(floor((2 * k + 1) * (SELECT count(*) FROM part) / 34.0) AS BIGINT) FROM range(0, 17) t(k)) AS marked FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part)")
def w12(s, d):
    n = V.table(s, d, "part").count()
    places = [int((2 * k + 1) * n // 34) for k in range(17)]
    r = V.table(s, d, "part").select("p_partkey", (F.row_number().over(W.orderBy("p_partkey")) - 1).alias("r"))
    return r.select(F.col("p_partkey").alias("id"), F.col("r").isin(places).alias("marked"))


@query("w13_hash_labels", "SELECT p_partkey AS id, CASE WHEN r <= 40 THEN 'planted' WHEN r <= 100 THEN 'null' ELSE 'none' END AS label FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('5:' || p_partkey), p_partkey) AS r FROM part)")
def w13(s, d):
    r = F.row_number().over(W.orderBy(F.md5(F.concat(F.lit("5:"), F.col("p_partkey").cast("string"))), "p_partkey"))
    return V.table(s, d, "part").withColumn("r", r).select(F.col("p_partkey").alias("id"), F.when(F.col("r") <= 40, "planted").when(F.col("r") <= 100, "null").otherwise("none").alias("label"))


@query("g61_niche_ligand", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, "far AS (SELECT DISTINCT p.src, q.dst FROM ends p JOIN ends q ON p.dst = q.src WHERE p.src <> q.dst AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.src = p.src AND e.dst = q.dst))", "SELECT src AS cell, round(ln(1 + avg(coalesce(c.count / f, 0))), 7) AS niche FROM far LEFT JOIN (FROM counts WHERE feature = 'Brand#23') c ON c.cell = dst LEFT JOIN factor ON factor.cell = dst GROUP BY 1"))
def g61(s, d):
    v = V.counts(s, d).filter("feature = 'Brand#23'").join(factors(s, d), "cell").select(F.col("cell").alias("dst"), (F.col("count") / F.col("size_factor")).alias("v"))
    far = G.second_neighbours(V.contacts(s, d)).join(v, "dst", "left")
    return far.groupBy(F.col("src").alias("cell")).agg(F.round(F.log1p(F.avg(F.coalesce("v", F.lit(0.0)))), 7).alias("niche"))


@query("g62_expected_bleed", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, "m AS (SELECT kind, avg(coalesce(count / f, 0)) AS m FROM cells LEFT JOIN (FROM counts WHERE feature = 'Brand#23') USING (cell) LEFT JOIN factor USING (cell) GROUP BY 1)", "SELECT src AS cell, round(ln(1 + sum(g.f * m) / any_value(h.f)), 6) AS bleed FROM ends JOIN cells ON cells.cell = dst JOIN m USING (kind) JOIN factor g ON g.cell = dst JOIN factor h ON h.cell = src GROUP BY 1"))
def g62(s, d):
    f, cells = factors(s, d), V.cells(s, d).select("cell", "kind")
    c = V.counts(s, d).filter("feature = 'Brand#23'")
    m = cells.join(c, "cell", "left").join(f, "cell", "left").groupBy("kind").agg(F.avg(F.coalesce(F.col("count") / F.col("size_factor"), F.lit(0.0))).alias("m"))
    side = cells.join(m, "kind").join(f, "cell").select("cell", (F.col("size_factor") * F.col("m")).alias("v"))
    total = G.neighbour_sum(V.contacts(s, d), side, "v").select(F.col("src").alias("cell"), "total").join(f, "cell")
    return total.select("cell", F.round(F.log1p(F.col("total") / F.col("size_factor")), 6).alias("bleed"))


@query("g67_identified", sql(FINE, "SELECT string_split(feature, '|')[1] AS feature, bool_or(string_split(feature, '|')[2]::INT <= 25) AND bool_or(string_split(feature, '|')[2]::INT > 25) AS identified FROM counts WHERE count > 0 GROUP BY 1"))
def g67(s, d):
    c = V.counts(s, d, fine=True).filter("count > 0").select(F.split("feature", r"\|")[0].alias("feature"), (F.split("feature", r"\|")[1].cast("int") <= 25).alias("low"))
    return c.groupBy("feature").agg((F.max("low") & F.max(~F.col("low"))).alias("identified"))


@query("g68_dominant_neighbour_kind", sql(CELLS, CONTACTS, BOTH, "SELECT src AS cell, first(kind ORDER BY n DESC, kind) AS label FROM (SELECT src, kind, count(*) AS n FROM ends JOIN cells ON cell = dst GROUP BY 1, 2) GROUP BY 1"))
def g68(s, d):
    met = G.both_ways(V.contacts(s, d)).join(V.cells(s, d).select(F.col("cell").alias("dst"), "kind"), "dst")
    return G.majority(met, "src", F.col("kind")).withColumnRenamed("src", "cell")


@query("g69_region_levels", sql(CELLS, "SELECT section, kind AS region FROM (SELECT section, kind, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, kind) AS r FROM cells GROUP BY 1, 2) WHERE r > 1"))
def g69(s, d):
    n = V.cells(s, d).groupBy("section", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("section").orderBy(F.desc("n"), "kind"))).filter("r > 1").select("section", F.col("kind").alias("region"))


@query("g54_benchmark_rates", sql(TESTS, "SELECT fam AS scenario, round(avg((p < 0.05)::INT), 9) AS rate, count(*) AS n FROM t WHERE NOT isnan(p) GROUP BY 1"))
def g54(s, d):
    t = tests(s, d).filter(~F.isnan("p"))
    return t.groupBy(F.col("fam").alias("scenario")).agg(F.round(F.avg((F.col("p") < 0.05).cast("int")), 9).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("g56_variance_shares", sql(CELLS, "SELECT kind, round(var_pop(x) / (var_pop(x) + var_pop(y)), 7) AS share_x, round(var_pop(y) / (var_pop(x) + var_pop(y)), 7) AS share_y FROM cells GROUP BY 1"))
def g56(s, d):
    vx, vy = F.var_pop("x"), F.var_pop("y")
    return V.cells(s, d).groupBy("kind").agg(F.round(vx / (vx + vy), 7).alias("share_x"), F.round(vy / (vx + vy), 7).alias("share_y"))


@query("m60_pair_map", sql(CELLS, COUNTS, TOT, CONTACTS, BOTH, FACTOR, DOSE, "SELECT cell, CASE WHEN l.count > 0 THEN 'sender' WHEN dose > 40 AND kind < 'F' THEN 'exposed_competent' WHEN dose > 40 THEN 'exposed_incompetent' WHEN kind < 'F' THEN 'unexposed_competent' ELSE 'unexposed_incompetent' END AS class FROM dose JOIN cells USING (cell) LEFT JOIN (FROM counts WHERE feature = 'Brand#23') l USING (cell)"))
def m60(s, d):
    own = V.counts(s, d).filter("feature = 'Brand#23'").select("cell", "count")
    met = dose(s, d).join(V.cells(s, d).select("cell", "kind"), "cell").join(own, "cell", "left")
    competent, exposed = F.col("kind") < "F", F.col("dose") > 40
    cls = F.when(F.col("count") > 0, "sender").when(exposed & competent, "exposed_competent").when(exposed, "exposed_incompetent").when(competent, "unexposed_competent").otherwise("unexposed_incompetent")
    return met.select("cell", cls.alias("class"))


@query("g26_t_tails")
def g26_t(s, d):
    rows = estimates(s, d).withColumn("t", F.col("theta") / F.col("se"))
    return L.with_p(rows, "t", "df", "p").select("pair", "t", "df", "p")
