"""Queries over sparse counts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import graph as G
from ..operators import pool as P
from ..operators import stats as S
from ..sources import views as V
from ..sources.views import CELLS, COMMUNITIES, CONTACTS, COUNTS, FINE, sql
from .graph_queries import GROUPS, groups
from .registry import query

TOT = "tot AS (SELECT cell, sum(count) AS total FROM counts GROUP BY 1)"
NORM = "norm AS (SELECT cell, feature, ln(1 + 10000 * count / total) AS value FROM counts JOIN tot USING (cell))"


@query("g1_row_totals", sql(COUNTS, "SELECT feature, sum(count) AS total FROM counts GROUP BY 1"))
def g1(s, d):
    return P.totals(V.counts(s, d), "feature")


@query("g2_column_totals", sql(COUNTS, "SELECT cell, sum(count) AS total FROM counts GROUP BY 1"))
def g2(s, d):
    return P.totals(V.counts(s, d), "cell")


@query("p1_log_cp10k", sql(COUNTS, TOT, NORM, "SELECT cell, feature, round(value, 9) AS value FROM norm"))
def p1(s, d):
    return P.normalised(V.counts(s, d)).withColumn("value", F.round("value", 9))


@query("p2_log_depth", sql(COUNTS, TOT, "SELECT cell, round(ln(1 + total), 9) AS depth FROM tot"))
def p2(s, d):
    return P.totals(V.counts(s, d), "cell").select("cell", F.round(F.log1p("total"), 9).alias("depth"))


@query("p3_size_factors", sql(COUNTS, TOT, "m AS (SELECT list_sort(list(greatest(total, 1)))[count(*) // 2 + 1] AS med FROM tot)", "SELECT cell, round(greatest(total, 1) / greatest(med, 1), 9) AS size_factor FROM tot, m"))
def p3(s, d):
    depth = P.totals(V.counts(s, d), "cell").withColumn("depth", F.greatest(F.col("total"), F.lit(1.0)))
    med = S.upper_median_by(depth, [], "depth", "med")
    return depth.join(F.broadcast(med)).select("cell", F.round(F.col("depth") / F.greatest(F.col("med"), F.lit(1.0)), 9).alias("size_factor"))


DELTA = "delta AS (SELECT feature, section, (sum(count) / any_value(t)) / (any_value(ft) / any_value(gt)) AS delta FROM counts JOIN cells USING (cell) JOIN (SELECT section, sum(count) AS t FROM counts JOIN cells USING (cell) GROUP BY 1) USING (section) JOIN (SELECT feature, sum(count) AS ft FROM counts GROUP BY 1) USING (feature), (SELECT sum(count) AS gt FROM counts) GROUP BY 1, 2)"


def delta(s, d):
    met = V.counts(s, d).join(V.cells(s, d).select("cell", "section"), "cell").groupBy("feature", "section").agg(F.sum("count").alias("c"))
    share = F.col("c") / F.sum("c").over(W.partitionBy("section"))
    overall = F.sum("c").over(W.partitionBy("feature")) / F.sum("c").over(W.partitionBy())
    return met.select("feature", "section", (share / overall).alias("delta"))


@query("p4_batch_divide", sql(CELLS, COUNTS, DELTA, "SELECT cell, feature, round(CASE WHEN delta > 0 THEN count / delta ELSE count END, 6) AS value FROM counts JOIN cells USING (cell) LEFT JOIN delta USING (feature, section)"))
def p4(s, d):
    met = V.counts(s, d).join(V.cells(s, d).select("cell", "section"), "cell").join(delta(s, d), ["feature", "section"], "left")
    return met.select("cell", "feature", F.round(E.divide_batch(F.col("count"), F.col("delta")), 6).alias("value"))


@query("p5_ratio_divide", sql(CELLS, COUNTS, TOT, DELTA, "m AS (SELECT cell, feature, count, delta, sum(count) OVER (PARTITION BY cell) / sum(count / delta) OVER (PARTITION BY cell) AS ratio FROM counts JOIN cells USING (cell) JOIN delta USING (feature, section))", "SELECT cell, feature, round(count / delta * ratio, 6) AS value FROM m"))
def p5(s, d):
    met = V.counts(s, d).join(V.cells(s, d).select("cell", "section"), "cell").join(delta(s, d), ["feature", "section"])
    w = W.partitionBy("cell")
    return met.select("cell", "feature", F.round(F.col("count") / F.col("delta") * F.sum("count").over(w) / F.sum(F.col("count") / F.col("delta")).over(w), 6).alias("value"))


@query("p6_drop_features", sql(COUNTS, "SELECT cell, feature, count FROM counts WHERE NOT regexp_matches(feature, '^Brand#(1|5)')"))
def p6(s, d):
    return V.counts(s, d).filter(~F.col("feature").rlike("^Brand#(1|5)"))


@query("p9_feature_count_filter", sql(FINE, "SELECT cell, feature, count FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY 1 HAVING sum(count) >= 1500)"))
def p9(s, d):
    c = V.counts(s, d, fine=True)
    return c.join(P.totals(c, "feature").filter("total >= 1500"), "feature", "left_semi")


@query("p10_min_cells", sql(FINE, "SELECT feature, count(*) AS cells FROM counts GROUP BY 1 HAVING count(*) >= 50"))
def p10(s, d):
    return V.counts(s, d, fine=True).groupBy("feature").agg(F.count(F.lit(1)).alias("cells")).filter("cells >= 50")


@query(
    "p11_mad_outliers",
    sql(CELLS, COUNTS, TOT, "m AS (SELECT section, list_sort(list(total))[count(*) // 2 + 1] AS med FROM tot JOIN cells USING (cell) GROUP BY 1), v AS (SELECT cell, section, total, abs(total - med) AS dev, med FROM tot JOIN cells USING (cell) JOIN m USING (section)), q AS (SELECT section, list_sort(list(dev))[count(*) // 2 + 1] AS mad FROM v GROUP BY 1)", "SELECT cell, section, total FROM v JOIN q USING (section) WHERE abs((total - med) / greatest(mad * 1.4826, 1e-9)) <= 2"),
)
def p11(s, d):
    t = P.totals(V.counts(s, d), "cell").join(V.cells(s, d).select("cell", "section"), "cell")
    return S.mad_outliers(t, ["section"], "total", 2.0).select("cell", "section", "total")


@query("p12_symbol", "SELECT p_partkey AS part, p_name AS symbol FROM part")
def p12(s, d):
    p = V.table(s, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ENSG00000"), F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("part"), E.symbol(name).alias("symbol"))


@query("p13_gene_lookup", "WITH n AS (SELECT p_type AS symbol, p_name AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) SELECT symbol, name FROM n WHERE r = 1")
def p13(s, d):
    p = V.table(s, d, "part")
    return p.groupBy(F.col("p_type").alias("symbol")).agg(F.min_by("p_name", "p_partkey").alias("name"))


@query("p14_pair_selection", "SELECT p_partkey AS part, array_to_string(list_sort(string_split(upper(trim(p_type)), '_')), '_') AS canonical, levenshtein(p_brand, 'Brand#13') AS edits FROM part")
def p14(s, d):
    return V.table(s, d, "part").select(F.col("p_partkey").alias("part"), E.canonical_pair(F.col("p_type")).alias("canonical"), F.levenshtein("p_brand", F.lit("Brand#13")).cast("long").alias("edits"))


@query("p17_quantile_nearest", sql(COUNTS, "q AS (SELECT feature, list_sort(list(count)) AS v, count(*) AS n FROM counts GROUP BY 1)", "SELECT feature, v[CAST(floor((n - 1) * 0.25 + 0.5) AS INT) + 1] AS q25, v[CAST(floor((n - 1) * 0.9 + 0.5) AS INT) + 1] AS q90 FROM q"))
def p17(s, d):
    c = V.counts(s, d)
    return S.quantile_by(c, ["feature"], "count", 0.25, "q25").join(S.quantile_by(c, ["feature"], "count", 0.9, "q90"), "feature")


@query("p18_upper_median", sql(COUNTS, "SELECT feature, list_sort(list(count))[count(*) // 2 + 1] AS median FROM counts GROUP BY 1"))
def p18(s, d):
    return S.upper_median_by(V.counts(s, d), ["feature"], "count", "median")


@query("p19_unit_rows", "WITH f AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) SELECT vec_id, k - 1 AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS v FROM f")
def p19(s, d):
    e = V.table(s, d, "embeddings").select("vec_id", E.unit_row(F.transform("embedding", lambda v: v.cast("double"))).alias("u"))
    return e.select("vec_id", F.posexplode("u").alias("place", "v")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("v"))


@query("p20_z_scores", sql(CELLS, COUNTS, "l AS (SELECT section, feature, sum(count) AS level FROM counts JOIN cells USING (cell) GROUP BY 1, 2)", "SELECT section, feature, round(greatest(-2.5, least(2.5, (level - avg(level) OVER (PARTITION BY feature)) / stddev_samp(level) OVER (PARTITION BY feature))), 6) AS z FROM l"))
def p20(s, d):
    level = V.counts(s, d).join(V.cells(s, d).select("cell", "section"), "cell").groupBy("section", "feature").agg(F.sum("count").alias("level"))
    w = W.partitionBy("feature")
    z = (F.col("level") - F.avg("level").over(w)) / F.stddev_samp("level").over(w)
    return level.select("section", "feature", F.round(F.greatest(F.lit(-2.5), F.least(F.lit(2.5), z)), 6).alias("z"))


@query("p23_permute_within", sql(CELLS, "o AS (SELECT cell, section, row_number() OVER (PARTITION BY section ORDER BY cell) AS r FROM cells), h AS (SELECT x, section, row_number() OVER (PARTITION BY section ORDER BY md5('7:' || cell), cell) AS r FROM cells)", "SELECT o.cell, o.section, h.x FROM o JOIN h USING (section, r)"))
def p23(s, d):
    c = V.cells(s, d)
    own = c.select("cell", "section", F.row_number().over(W.partitionBy("section").orderBy("cell")).alias("r"))
    drawn = c.select("x", "section", F.row_number().over(W.partitionBy("section").orderBy(F.md5(F.concat(F.lit("7:"), F.col("cell").cast("string"))), "cell")).alias("r"))
    return own.join(drawn, ["section", "r"]).select("cell", "section", "x")


@query("g3_running_stats", sql(COUNTS, "n AS (SELECT count(*) AS n FROM customer)", "SELECT feature, round(sum(count) / any_value(n), 6) AS mean, round((sum(count * count) - sum(count) * sum(count) / any_value(n)) / (any_value(n) - 1), 4) AS variance, count(*) FILTER (count > 0) AS detected FROM counts, n GROUP BY 1"))
def g3(s, d):
    n = V.table(s, d, "customer").count()
    return P.moments(V.counts(s, d), n).withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 4))


@query("g4_fold_channels", sql(FINE, "SELECT cell, string_split(feature, '|')[1] AS feature, sum(count) AS count FROM counts GROUP BY 1, 2"))
def g4(s, d):
    return V.counts(s, d, fine=True).groupBy("cell", F.split("feature", r"\|")[0].alias("feature")).agg(F.sum("count").alias("count"))


@query("g5_pseudobulk", sql(CELLS, COUNTS, GROUPS, 'SELECT "group", feature, sum(count) AS count FROM counts JOIN g USING (cell) GROUP BY 1, 2'))
def g5(s, d):
    return P.pseudobulk(V.counts(s, d), groups(s, d))


SHARES = "shares AS (SELECT cell, community, count(*) / sum(count(*)) OVER (PARTITION BY cell) AS share FROM (SELECT a AS cell, community FROM communities UNION ALL SELECT b, community FROM communities) GROUP BY 1, 2)"
BASE = (CELLS, COUNTS, CONTACTS, COMMUNITIES, SHARES)


@query("g8_membership", sql(*BASE, "SELECT cell, community, round(share, 9) AS share FROM shares"))
def g8(s, d):
    return P.membership(V.communities(s, d)).withColumn("share", F.round("share", 9))


@query("g9_dominant_cluster", sql(*BASE, "SELECT cell, coalesce(first(community ORDER BY share DESC, community), 0) AS cluster FROM cells LEFT JOIN shares USING (cell) GROUP BY 1"))
def g9(s, d):
    return P.dominant(P.membership(V.communities(s, d)), V.cells(s, d))


@query("g10_entropy", sql(*BASE, "SELECT cell, round(coalesce(-sum(share * ln(share)), 'NaN'::DOUBLE), 9) + 0.0 AS entropy FROM cells LEFT JOIN shares USING (cell) GROUP BY 1"))
def g10(s, d):
    return P.entropy(P.membership(V.communities(s, d)), V.cells(s, d)).withColumn("entropy", F.round("entropy", 9) + 0.0)


@query("g11_feature_community", sql(*BASE, "SELECT feature, community, round(any_value(e), 6) AS exposure, round(sum(count * share), 6) AS total, round((1 + sum(count * share)) / (1 + any_value(e)), 6) AS mean FROM counts JOIN shares USING (cell) JOIN (SELECT community, sum(share) AS e FROM shares GROUP BY 1) USING (community) GROUP BY 1, 2"))
def g11(s, d):
    out = P.feature_community(V.counts(s, d), P.membership(V.communities(s, d)))
    return out.select("feature", "community", *[F.round(c, 6).alias(c) for c in ("exposure", "total", "mean")])


STATS = "stats AS (SELECT community, feature, sum(count) AS total FROM pooled JOIN communities USING (a, b) GROUP BY 1, 2)"


@query("g13_community_stats", sql(CELLS, COUNTS, CONTACTS, COMMUNITIES.replace("SELECT a, b, feature, row_number", "SELECT a, b, feature, row_number"), STATS, "SELECT community, feature, total FROM stats"))
def g13(s, d):
    return P.community_stats(V.communities(s, d), G.pool_endpoints(V.contacts(s, d), V.counts(s, d)))


@query("g14_plug_in_score", sql(CELLS, COUNTS, CONTACTS, COMMUNITIES, STATS, "v AS (SELECT sum(v * ln(v)) AS fv FROM (SELECT sum(total) AS v FROM stats GROUP BY community)), f AS (SELECT sum(g * ln(g)) AS fg FROM (SELECT sum(total) AS g FROM stats GROUP BY feature)), t AS (SELECT sum(total * ln(total)) AS fd, sum(total) AS n FROM stats)", "SELECT round(fd - fv, 3) AS score, round((fd - fv - fg + n * ln(n)) / n, 8) AS mutual_information, n AS total_mass FROM t, v, f"))
def g14(s, d):
    out = P.plug_in_score(g13(s, d))
    return out.select(F.round("score", 3).alias("score"), F.round("mutual_information", 8).alias("mutual_information"), "total_mass")


@query("g16_community_shares", sql(CELLS, COUNTS, CONTACTS, COMMUNITIES, "SELECT community, section, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY community), 9) AS share FROM communities GROUP BY 1, 2"))
def g16(s, d):
    n = V.communities(s, d).groupBy("community", "section").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("community")), 9))


KINDS = "g AS (SELECT cell, kind AS \"group\" FROM cells)"
LEVELS = 'levels AS (SELECT "group", feature, sum(value) / any_value(n) AS level FROM norm JOIN g USING (cell) JOIN (SELECT "group", count(*) AS n FROM g GROUP BY 1) USING ("group") GROUP BY 1, 2)'


def kinds(s, d):
    return V.cells(s, d).select("cell", F.col("kind").alias("group"))


@query("g45_group_means", sql(CELLS, COUNTS, TOT, NORM, KINDS, LEVELS, 'SELECT "group", feature, round(level, 7) AS level FROM levels'))
def g45(s, d):
    return P.group_levels(V.counts(s, d), kinds(s, d)).withColumn("level", F.round("level", 7))


@query("g44_markers", sql(CELLS, COUNTS, TOT, NORM, KINDS, LEVELS, 'f AS (SELECT "group", feature, (level + 0.1) / ((sum(level) OVER (PARTITION BY feature) - level) / greatest(count(*) OVER (PARTITION BY feature) - 1, 1) + 0.1) AS fold FROM levels)', 'SELECT "group", feature, round(fold, 7) AS fold, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY fold DESC, feature) AS r FROM f) WHERE r <= 3'))
def g44(s, d):
    return P.markers(P.group_levels(V.counts(s, d), kinds(s, d)), 0.1, 3).withColumn("fold", F.round("fold", 7))


@query("g46_margins", sql(CELLS, COUNTS, TOT, NORM, KINDS, LEVELS, 'r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY level DESC, "group") AS r, lead(level) OVER (PARTITION BY feature ORDER BY level DESC, "group") AS next FROM levels)', 'SELECT feature, "group", round(level - coalesce(next, 0), 7) AS margin FROM r WHERE r = 1'))
def g46(s, d):
    w = W.partitionBy("feature").orderBy(F.desc("level"), "group")
    r = P.group_levels(V.counts(s, d), kinds(s, d)).withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("level").over(w))
    return r.filter("r = 1").select("feature", "group", F.round(F.col("level") - F.coalesce("next", F.lit(0.0)), 7).alias("margin"))


@query("g41_highly_variable", sql(FINE, "n AS (SELECT count(*) AS n FROM customer), m AS (SELECT feature, sum(count) / any_value(n) AS mean, (sum(count * count) - sum(count) * sum(count) / any_value(n)) / (any_value(n) - 1) AS variance FROM counts, n GROUP BY 1), b AS (SELECT feature, ln(variance / mean) AS dispersion, ntile(5) OVER (ORDER BY mean, feature) AS bin FROM m WHERE mean > 0 AND variance > 0), z AS (SELECT feature, dispersion, (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / stddev_samp(dispersion) OVER (PARTITION BY bin) AS z FROM b)", "SELECT feature, round(dispersion, 6) AS dispersion, round(z, 5) AS z, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY z DESC NULLS LAST, feature) AS r FROM z) WHERE r <= 50"))
def g41(s, d):
    n = V.table(s, d, "customer").count()
    return P.highly_variable(V.counts(s, d, fine=True), n, 50).select("feature", F.round("dispersion", 6).alias("dispersion"), F.round("z", 5).alias("z"), "rank")


@query("g43_top_features", sql(FINE, "SELECT feature, sum(count) AS total FROM counts GROUP BY 1 ORDER BY total DESC, feature LIMIT 20"))
def g43(s, d):
    return P.totals(V.counts(s, d, fine=True), "feature").orderBy(F.desc("total"), "feature").limit(20)


@query("g52_majority_label", sql(CELLS, "SELECT section, kind AS label FROM (SELECT section, kind, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, kind) AS r FROM cells GROUP BY 1, 2) WHERE r = 1"))
def g52(s, d):
    return G.majority(V.cells(s, d), "section", F.col("kind"))


@query("g53_refine_by_neighbours", sql(CELLS, CONTACTS, "ends AS (SELECT a AS src, b AS dst FROM contacts UNION ALL SELECT b, a FROM contacts UNION ALL SELECT cell, cell FROM cells), v AS (SELECT src, kind, count(*) AS n FROM ends JOIN cells ON dst = cell GROUP BY 1, 2)", "SELECT v.src AS cell, first(v.kind ORDER BY v.n DESC, (v.kind <> c.kind), v.kind) AS label FROM v JOIN cells c ON v.src = c.cell GROUP BY 1"))
def g53(s, d):
    c = V.cells(s, d).select("cell", "kind")
    ends = G.both_ways(V.contacts(s, d)).unionByName(c.select(F.col("cell").alias("src"), F.col("cell").alias("dst")))
    votes = ends.join(c.select(F.col("cell").alias("dst"), "kind"), "dst").groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))
    own = c.select(F.col("cell").alias("src"), F.col("kind").alias("own"))
    best = votes.join(own, "src").groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("kind") != F.col("own")).alias("o"), "kind"))["kind"].alias("label"))
    return best.select(F.col("src").alias("cell"), "label")


@query("g57_active_edges", sql(CELLS, COUNTS, CONTACTS, "SELECT feature, a, b, sum(count) AS weight FROM (SELECT a, b, a AS cell FROM contacts UNION ALL SELECT a, b, b FROM contacts) JOIN counts USING (cell) WHERE count > 0 GROUP BY ALL"))
def g57(s, d):
    return G.pool_endpoints(V.contacts(s, d), V.counts(s, d)).filter("count > 0").select("feature", "a", "b", F.col("count").alias("weight"))


@query("g58_fold_active_edges", sql(CELLS, COUNTS, CONTACTS, GROUPS, 'SELECT feature, least(p."group", q."group") AS a, greatest(p."group", q."group") AS b, sum(count) AS weight FROM (SELECT a, b, a AS cell FROM contacts UNION ALL SELECT a, b, b FROM contacts) JOIN counts USING (cell) JOIN g p ON a = p.cell JOIN g q ON b = q.cell WHERE p."group" <> q."group" GROUP BY 1, 2, 3'))
def g58(s, d):
    g = groups(s, d)
    met = g57(s, d).join(g.select(F.col("cell").alias("a"), F.col("group").alias("ga")), "a").join(g.select(F.col("cell").alias("b"), F.col("group").alias("gb")), "b").filter("ga <> gb")
    return met.groupBy("feature", F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("weight").alias("weight"))


@query("g60_nesting", sql(CELLS, 'SELECT section, count(DISTINCT donor) AS parents FROM cells GROUP BY 1'))
def g60(s, d):
    return V.cells(s, d).groupBy("section").agg(F.countDistinct("donor").alias("parents"))


@query("g64_specificity", sql(COUNTS, "n AS (SELECT count(DISTINCT cell) AS n FROM counts)", "SELECT feature, round(ln((any_value(n) + 1) / (count(DISTINCT cell) + 1)), 9) AS weight FROM counts, n GROUP BY 1"))
def g64(s, d):
    c = V.counts(s, d)
    n = c.select("cell").distinct().count()
    return c.groupBy("feature").agg(F.round(F.log(F.lit(n + 1.0) / (F.countDistinct("cell") + 1)), 9).alias("weight"))


@query("g72_cells_per_domain_donor", sql(CELLS, "SELECT kind, donor, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY donor), 9) AS share FROM cells GROUP BY 1, 2"))
def g72(s, d):
    n = V.cells(s, d).groupBy("kind", "donor").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("donor")), 9))


@query("s3_feature_intersection", sql(CELLS, FINE, "SELECT feature FROM counts JOIN cells USING (cell) GROUP BY 1 HAVING count(DISTINCT section) = (SELECT count(DISTINCT section) FROM cells)"))
def s3(s, d):
    met = V.counts(s, d, fine=True).join(V.cells(s, d).select("cell", "section"), "cell")
    n = V.cells(s, d).select("section").distinct().count()
    return met.groupBy("feature").agg(F.countDistinct("section").alias("n")).filter(F.col("n") == n).select("feature")


@query("s4_coverage_mass", sql(CELLS, FINE, "f AS (SELECT DISTINCT feature, section FROM counts JOIN cells USING (cell)), m AS (SELECT section, count(*) AS mass FROM cells GROUP BY 1)", "SELECT feature, CAST(sum(mass) AS BIGINT) AS mass, count(*) AS files FROM f JOIN m USING (section) GROUP BY 1"))
def s4(s, d):
    cells = V.cells(s, d)
    seen = V.counts(s, d, fine=True).join(cells.select("cell", "section"), "cell").select("feature", "section").distinct()
    return seen.join(cells.groupBy("section").agg(F.count(F.lit(1)).alias("mass")), "section").groupBy("feature").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("files"))


@query("s20_module_sums", sql(FINE, "SELECT cell, ascii(feature) + CAST(string_split(feature, '|')[2] AS INT) % 7 AS module, sum(count) AS count FROM counts GROUP BY 1, 2"))
def s20(s, d):
    module = F.ascii("feature") + F.split("feature", r"\|")[1].cast("int") % 7
    return V.counts(s, d, fine=True).groupBy("cell", module.alias("module")).agg(F.sum("count").alias("count"))
