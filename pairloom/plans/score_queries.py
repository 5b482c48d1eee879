"""Queries that compare partitions and score rankings."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import pool as P
from ..operators import score as C
from ..operators import stats as S
from ..sources import views as V
from ..sources.views import CELLS, sql
from .registry import query

PARTS = "l AS (SELECT p_brand AS a, p_type AS b FROM part)"


def parts(s, d):
    return V.table(s, d, "part").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"))


@query("g17_contingency", sql(PARTS, "n AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2)", "SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS fraction_of_a, round(n / sum(n) OVER (PARTITION BY b), 9) AS fraction_of_b, round(n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n), 9) AS jaccard FROM n"))
def g17(s, d):
    return C.contingency(parts(s, d)).select("a", "b", "n", *[F.round(c, 9).alias(c) for c in ("fraction_of_a", "fraction_of_b", "jaccard")])


COLLAPSED = "n AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2), c AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS h FROM n), r AS (SELECT sum(s * (s - 1) / 2) AS ca, sum(s * ln(s)) AS ha FROM (SELECT sum(n) AS s FROM n GROUP BY a)), k AS (SELECT sum(s * (s - 1) / 2) AS cb, sum(s * ln(s)) AS hb FROM (SELECT sum(n) AS s FROM n GROUP BY b))"
SEGMENTS = "l AS (SELECT c_nationkey % 5 AS a, n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def segments(s, d):
    return V.cells(s, d).select((F.col("section") % 5).alias("a"), F.col("donor").alias("b"))


@query("g18_ari", sql(SEGMENTS, COLLAPSED, "SELECT round((c - ca * cb / (n * (n - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (n * (n - 1) / 2)), 8) AS ari FROM c, r, k"))
def g18(s, d):
    return C.ari(segments(s, d)).select(F.round("ari", 8).alias("ari"))


@query("g19_nmi", sql(SEGMENTS, COLLAPSED, "SELECT round(2 * (ln(n) + (h - ha - hb) / n) / (2 * ln(n) - ha / n - hb / n), 8) AS nmi FROM c, r, k"))
def g19(s, d):
    return C.nmi(segments(s, d)).select(F.round("nmi", 8).alias("nmi"))


@query("g20_ami")
def g20(s, d):
    return C.ami(segments(s, d))


@query("m27_matching")
def m27(s, d):
    return C.match(parts(s, d))


@query(
    "m28_fates",
    sql(SEGMENTS, "n AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), f AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS fa, n / sum(n) OVER (PARTITION BY b) AS fb FROM n), s AS (SELECT a, b, count(*) OVER (PARTITION BY b) AS others FROM f WHERE fa >= 0.25 OR fb >= 0.25), g AS (SELECT a, count(*) AS partners, max(others) AS others FROM s GROUP BY 1)", "SELECT DISTINCT n.a, coalesce(partners, 0) AS partners, CASE WHEN coalesce(partners, 0) = 0 THEN 'vanished' WHEN partners > 1 THEN 'split' WHEN others > 1 THEN 'merged' ELSE 'kept' END AS fate FROM n LEFT JOIN g USING (a)"),
)
def m28(s, d):
    return C.fates(C.contingency(segments(s, d)), 0.25)


@query("j10_partition_join", "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM (SELECT doc_id AS a FROM labels) FULL JOIN (SELECT doc_id AS b FROM documents) ON a = b")
def j10(s, d):
    a = V.table(s, d, "labels").select(F.col("doc_id").alias("a"))
    b = V.table(s, d, "documents").select(F.col("doc_id").alias("b"))
    met = a.join(b, F.col("a") == F.col("b"), "full")
    return met.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))


SCORED = "s AS (SELECT quality AS truth, n_chars % 50 AS score, toxic AS fam FROM labels JOIN documents USING (doc_id))"


def scored(s, d):
    return V.table(s, d, "labels").join(V.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") % 50).alias("score"), F.col("toxic").alias("fam"))


@query("g23_auroc", sql(SCORED, "r AS (SELECT *, rank() OVER (PARTITION BY fam ORDER BY score) + (count(*) OVER (PARTITION BY fam, score) - 1) / 2.0 AS r FROM s)", "SELECT fam, round((sum(r) FILTER (truth = 1) - sum(truth) * (sum(truth) + 1) / 2.0) / (sum(truth) * sum(1 - truth)), 8) AS auroc FROM r GROUP BY 1"))
def g23(s, d):
    return C.auroc(scored(s, d), ["fam"]).withColumn("auroc", F.round("auroc", 8))


@query("g24_average_precision", sql(SCORED, "t AS (SELECT fam, score, sum(truth) AS pos, count(*) AS n FROM s GROUP BY 1, 2), p AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS prec FROM t WINDOW w AS (PARTITION BY fam ORDER BY score DESC))", "SELECT fam, round(sum(pos * prec) / sum(pos), 8) AS ap FROM p GROUP BY 1"))
def g24(s, d):
    return C.average_precision(scored(s, d), ["fam"]).withColumn("ap", F.round("ap", 8))


@query("w6_midranks", sql(SCORED, "SELECT fam, score, round(rank() OVER (PARTITION BY fam ORDER BY score) + (count(*) OVER (PARTITION BY fam, score) - 1) / 2.0, 3) AS r FROM s"))
def w6(s, d):
    return S.midranks(scored(s, d), ["fam"], "score", "r").select("fam", "score", F.round("r", 3).alias("r"))


@query("g21_invariance", sql(CELLS, "j AS (SELECT kind AS domain, section % 4 AS label, donor, count(*)::DOUBLE AS n FROM cells GROUP BY 1, 2, 3), w AS (SELECT sum(h) AS within FROM (SELECT sum(n) * ln(sum(n)) - sum(n * ln(n)) AS h FROM j GROUP BY domain, label)), a AS (SELECT sum(h) AS al FROM (SELECT sum(n) * ln(sum(n)) - sum(n * ln(n)) AS h FROM (SELECT domain, donor, sum(n) AS n FROM j GROUP BY 1, 2) GROUP BY domain))", "SELECT round(within / al, 8) AS invariance FROM w, a"))
def g21(s, d):
    rows = V.cells(s, d).select(F.col("kind").alias("domain"), (F.col("section") % 4).alias("label"), "donor")
    return C.conditional_entropy_ratio(rows).select(F.round("invariance", 8).alias("invariance"))


@query("g22_patches", sql(CELLS, "r AS (SELECT donor AS owner, kind AS domain, section AS label FROM cells), n AS (SELECT owner, domain, label, count(*) AS n FROM r GROUP BY 1, 2, 3), f AS (SELECT owner, domain, label, n, 2.0 * n / (sum(n) OVER (PARTITION BY owner, label) + sum(n) OVER (PARTITION BY owner, domain)) AS f1 FROM n)", "SELECT owner, domain, label, round(f1, 8) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY owner, domain ORDER BY round(f1, 12) DESC, n DESC, label) AS k FROM f) WHERE k = 1"))
def g22(s, d):
    rows = V.cells(s, d).select(F.col("donor").alias("owner"), F.col("kind").alias("domain"), F.col("section").alias("label"))
    return C.patches(rows).withColumn("f1", F.round("f1", 8))


UNITS = "u AS (SELECT o_custkey AS unit, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS llik_a, count(*) * 140000.0 AS llik_b, count(*)::DOUBLE AS n FROM orders GROUP BY 1)"


def units(s, d):
    u = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("llik_a"), (F.count(F.lit(1)) * 140000.0).alias("llik_b"), F.count(F.lit(1)).cast("double").alias("count_a"))
    return u.withColumn("count_b", F.col("count_a")).join(V.cells(s, d).select("cell", F.col("section").alias("donor")), "cell")


@query("g50_paired_delta", sql(UNITS, "SELECT c_nationkey AS donor, round(sum(llik_a - llik_b) / sum(n), 5) AS delta, sum(n) AS count FROM u JOIN customer ON unit = c_custkey GROUP BY 1"))
def g50(s, d):
    return C.paired(units(s, d)).withColumn("delta", F.round("delta", 5))


@query("g50_paired_tests")
def g50_tests(s, d):
    deltas = [r["delta"] for r in P.collected(C.paired(units(s, d)).orderBy("donor"), 10_000)]
    return s.createDataFrame([(len(deltas), C.sign_test(deltas), C.wilcoxon(deltas))], "donors int, sign_p double, wilcoxon_p double")


@query("g49_heldout_totals", sql(UNITS, "SELECT c_nationkey AS section, round(sum(llik_a), 2) AS llik, sum(n) AS counts, round(sum(llik_a) / sum(n), 5) AS per_count FROM u JOIN customer ON unit = c_custkey GROUP BY 1"))
def g49(s, d):
    return units(s, d).groupBy(F.col("donor").alias("section")).agg(F.round(F.sum("llik_a"), 2).alias("llik"), F.sum("count_a").alias("counts"), F.round(F.sum("llik_a") / F.sum("count_a"), 5).alias("per_count"))


@query("j11_unit_join", "SELECT count(*) AS units, CAST(sum(CASE WHEN l.quality = l.toxic THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM labels l JOIN documents d USING (doc_id)")
def j11(s, d):
    met = V.table(s, d, "labels").join(V.table(s, d, "documents").select("doc_id"), "doc_id")
    return met.agg(F.count(F.lit(1)).alias("units"), F.sum(F.when(F.col("quality") == F.col("toxic"), 1).otherwise(0)).alias("agree"))


@query("j12_truth_join", "SELECT lang, count(*) AS n, count(quality) AS matched, count(*) - count(quality) AS unmatched FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def j12(s, d):
    met = V.table(s, d, "documents").select("doc_id", "lang").join(V.table(s, d, "labels"), "doc_id", "left")
    return met.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("matched"), (F.count(F.lit(1)) - F.count("quality")).alias("unmatched"))


@query(
    "j19_nearest_centroid",
    """WITH f AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
c AS (SELECT label AS c, k, avg(x) AS m FROM f GROUP BY 1, 2), s AS (SELECT vec_id, c, sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)) AS cosine FROM f JOIN c USING (k) GROUP BY 1, 2)
SELECT vec_id AS cell, c AS label, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, c) AS r FROM s) WHERE r = 1""",
)
def j19(s, d):
    from ..operators import latent

    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), "embedding", "label")
    return latent.nearest_centroid(e, latent.centroids(e, "label")).withColumn("cosine", F.round("cosine", 6))


@query("s10_label_reader", "SELECT CASE WHEN lower(trim(l)) IN ('', 'na', '-1', 'unassigned') THEN NULL ELSE l END AS label, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'NA' WHEN doc_id % 5 = 1 THEN 'unassigned' ELSE source END AS l FROM documents) GROUP BY 1")
def s10(s, d):
    from ..functions.expr import is_none_label

    raw = F.when(F.col("doc_id") % 5 == 0, "NA").when(F.col("doc_id") % 5 == 1, "unassigned").otherwise(F.col("source"))
    rows = V.table(s, d, "documents").select(raw.alias("l"))
    return rows.groupBy(F.when(is_none_label(F.col("l")), None).otherwise(F.col("l")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("o7_set_differences", "SELECT count(*) FILTER (side = 'a') AS only_a, count(*) FILTER (side = 'b') AS only_b FROM ((SELECT 'a' AS side, o_custkey AS k FROM orders EXCEPT SELECT 'a', c_custkey FROM customer) UNION ALL (SELECT 'b', c_custkey FROM customer EXCEPT SELECT 'b', o_custkey FROM orders))")
def o7(s, d):
    a = V.table(s, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = V.table(s, d, "customer").select(F.col("c_custkey").alias("k")).distinct()
    rows = a.join(b, "k", "left_anti").select(F.lit("a").alias("side")).unionByName(b.join(a, "k", "left_anti").select(F.lit("b").alias("side")))
    return rows.agg(F.count(F.when(F.col("side") == "a", 1)).alias("only_a"), F.count(F.when(F.col("side") == "b", 1)).alias("only_b"))


@query("o8_precedence_merge", "WITH u AS (SELECT p_partkey % 50 AS k, 1 AS pr, p_partkey AS v FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey % 50, 2, p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 UNION ALL SELECT p_partkey % 50, 3, p_partkey FROM part WHERE p_size > 30) SELECT k, pr, v FROM (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY pr) AS r FROM u) WHERE r = 1")
def o8(s, d):
    p = V.table(s, d, "part")
    pr = F.when(F.col("p_size") < 5, 1).when(F.col("p_size") <= 30, 2).otherwise(3)
    rows = p.select((F.col("p_partkey") % 50).alias("k"), pr.alias("pr"), F.col("p_partkey").alias("v"))
    return rows.withColumn("r", F.dense_rank().over(W.partitionBy("k").orderBy("pr"))).filter("r = 1").drop("r")


@query("o6_intersect_axes", "SELECT p_brand AS feature FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40")
def o6(s, d):
    p = V.table(s, d, "part")
    return p.filter("p_size < 10").select(F.col("p_brand").alias("feature")).intersect(p.filter("p_size > 40").select(F.col("p_brand").alias("feature")))


@query("o2_top_pairs", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o2(s, d):
    return V.table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o3_even_spread", "SELECT c_custkey AS cell, floor((r + 1) * 37.0 / n) > floor(r * 37.0 / n) AS chosen FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)")
def o3(s, d):
    c = V.table(s, d, "customer").select("c_custkey", (F.row_number().over(W.orderBy("c_custkey")) - 1).alias("r"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return c.select(F.col("c_custkey").alias("cell"), (F.floor((F.col("r") + 1) * 37.0 / F.col("n")) > F.floor(F.col("r") * 37.0 / F.col("n"))).alias("chosen"))


@query("w8_top_n", "SELECT p_brand, p_partkey, CAST(r AS INT) AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def w8(s, d):
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return V.table(s, d, "part").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("p_brand", "p_partkey", "rank")


@query("w9_block_split", sql(CELLS, "r AS (SELECT cell, section, row_number() OVER (PARTITION BY section ORDER BY cell) - 1 AS r, count(*) OVER (PARTITION BY section) AS n FROM cells)", "SELECT cell, section, CAST(r * 4 // n AS BIGINT) AS block FROM r"))
def w9(s, d):
    w = W.partitionBy("section")
    c = V.cells(s, d).select("cell", "section", (F.row_number().over(w.orderBy("cell")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return c.select("cell", "section", F.floor(F.col("r") * 4 / F.col("n")).alias("block"))
