"""Queries over contact graphs."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import views as V
from ..sources.views import BOTH, CELLS, COMMUNITIES, CONTACTS, COUNTS, sql
from .registry import query

K = "SELECT a, b, round(distance, 6) AS distance, section FROM contacts"


@query("j1_spatial_knn", sql(CELLS, CONTACTS, "SELECT a, b, round(distance, 6) AS distance, section FROM near WHERE rank <= 5"))
def j1(s, d):
    return G.knn(V.cells(s, d), 5).select("a", "b", F.round("distance", 6).alias("distance"), "section")


@query("j1_contacts", sql(CELLS, CONTACTS, K))
def j1_contacts(s, d):
    return V.contacts(s, d).select("a", "b", F.round("distance", 6).alias("distance"), "section")


@query("j1_reciprocal", sql(CELLS, CONTACTS, "SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(distance), 6) AS distance FROM near WHERE rank <= 5 GROUP BY 1, 2 HAVING count(*) = 2"))
def j1_reciprocal(s, d):
    return G.reciprocal(G.knn(V.cells(s, d), 5)).select("a", "b", F.round("distance", 6).alias("distance"))


@query("j5_radius_join", sql(CELLS, CONTACTS, "SELECT a, b, round(distance, 6) AS distance FROM near WHERE rank <= 8 AND distance <= 800"))
def j5(s, d):
    return G.radius(V.cells(s, d), 800.0, 8).select("a", "b", F.round("distance", 6).alias("distance"))


@query("j6_symmetrized", sql(CELLS, CONTACTS, BOTH, "SELECT src, dst FROM ends"))
def j6(s, d):
    return G.both_ways(V.contacts(s, d))


@query(
    "j2_expression_knn",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e, label FROM embeddings),
r AS (SELECT p.vec_id AS a, q.vec_id AS b, array_distance(p.e, q.e) AS d, row_number() OVER (PARTITION BY p.vec_id ORDER BY array_distance(p.e, q.e), q.vec_id) AS rank FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id)
SELECT a, b, round(d, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
)
def j2(s, d):
    from ..operators import latent

    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), "embedding", F.col("label").alias("section"))
    return latent.vector_knn(e, 5).select("a", "b", F.round("distance", 6).alias("distance"), "rank")


@query("j3_knn_within_component", sql(CELLS, CONTACTS, "big AS (SELECT section FROM cells GROUP BY 1 HAVING count(*) > 60)", "SELECT n.a, n.b FROM near n JOIN big USING (section) WHERE rank <= 5"))
def j3(s, d):
    cells = V.cells(s, d)
    kept = G.bounded(cells, cells.select("cell", F.col("section").alias("group")), 60)
    return G.knn(cells.join(kept, "cell", "left_semi"), 5).select("a", "b")


@query(
    "j7_augmented_graph",
    sql(
        CELLS,
        CONTACTS,
        """more AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(distance) AS distance FROM near WHERE rank <= 8 GROUP BY 1, 2),
u AS (SELECT a, b, distance, 0 AS edge_kind FROM contacts UNION ALL SELECT a, b, distance, 1 FROM more ANTI JOIN contacts USING (a, b))""",
        "SELECT a, b, edge_kind, round(percent_rank() OVER (PARTITION BY edge_kind ORDER BY distance), 9) AS weight FROM u",
    ),
)
def j7(s, d):
    more = G.undirected(G.knn(V.cells(s, d), 8))
    return G.unite(V.contacts(s, d), more).select("a", "b", "edge_kind", F.round("weight", 9).alias("weight"))


@query("j8_endpoint_pooling", sql(CELLS, COUNTS, CONTACTS, "SELECT a, b, feature, sum(count) AS count FROM (SELECT a, b, a AS cell FROM contacts UNION ALL SELECT a, b, b FROM contacts) JOIN counts USING (cell) GROUP BY 1, 2, 3"))
def j8(s, d):
    return G.pool_endpoints(V.contacts(s, d), V.counts(s, d))


@query(
    "j9_shared_difference",
    sql(CELLS, COUNTS, CONTACTS, "p AS (SELECT a, b, feature, sum(CASE WHEN cell = a THEN count ELSE 0 END) AS l, sum(CASE WHEN cell = b THEN count ELSE 0 END) AS r FROM (SELECT a, b, a AS cell FROM contacts UNION ALL SELECT a, b, b FROM contacts) JOIN counts USING (cell) GROUP BY 1, 2, 3)", "SELECT a, b, feature, l + r AS shared, abs(l - r) AS difference FROM p"),
)
def j9(s, d):
    return G.shared_difference(V.contacts(s, d), V.counts(s, d))


@query(
    "j15_neighbour_mean",
    sql(CELLS, COUNTS, CONTACTS, BOTH, "SELECT src, sum(coalesce(count, 0)) AS total, round(sum(coalesce(count, 0)) / count(*), 9) AS mean, count(*) AS degree FROM ends LEFT JOIN (SELECT * FROM counts WHERE feature = 'Brand#11') c ON c.cell = dst GROUP BY 1"),
)
def j15(s, d):
    return G.neighbour_sum(V.contacts(s, d), V.counts(s, d).filter("feature = 'Brand#11'"), "count").withColumn("mean", F.round("mean", 9))


@query("j16_second_neighbours", sql(CELLS, CONTACTS, BOTH, "SELECT DISTINCT p.src, q.dst FROM ends p JOIN ends q ON p.dst = q.src WHERE p.src <> q.dst AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.src = p.src AND e.dst = q.dst)"))
def j16(s, d):
    return G.second_neighbours(V.contacts(s, d))


@query("j21_nearest_cell", sql(CELLS, "p AS (SELECT section, max(x) / 2 AS px, max(y) / 2 AS py FROM cells GROUP BY 1)", "SELECT section, cell FROM (SELECT section, cell, row_number() OVER (PARTITION BY section ORDER BY (x - px) * (x - px) + (y - py) * (y - py), cell) AS n FROM cells JOIN p USING (section)) WHERE n = 1"))
def j21(s, d):
    cells = V.cells(s, d)
    p = cells.groupBy("section").agg((F.max("x") / 2).alias("px"), (F.max("y") / 2).alias("py"))
    far = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    return cells.join(p, "section").groupBy("section").agg(F.min(F.struct(far, "cell"))["cell"].alias("cell"))


@query("j23_receivers", sql(CELLS, CONTACTS, BOTH, "SELECT cell, section FROM cells WHERE cell IN (SELECT src FROM ends)"))
def j23(s, d):
    ends = G.both_ways(V.contacts(s, d)).select(F.col("src").alias("cell"))
    return V.cells(s, d).join(ends, "cell", "left_semi").select("cell", "section")


@query("p7_mask_induced_graph", sql(CELLS, CONTACTS, "SELECT a, b FROM contacts WHERE a % 7 <> 0 AND b % 7 <> 0"))
def p7(s, d):
    return G.induced(V.contacts(s, d), V.cells(s, d).filter("cell % 7 <> 0")).select("a", "b")


RINGS = [[(-500.0, 100.0), (6000.0, 100.0), (6000.0, 2500.0), (-500.0, 2500.0)], [(1000.0, 500.0), (3000.0, 700.0), (2000.0, 1500.0)]]
_SEGMENTS = ", ".join(f"({r[i][0]}, {r[i][1]}, {r[i - 1][0]}, {r[i - 1][1]})" for r in RINGS for i in range(len(r)))


@query("p8_point_in_polygon", sql(CELLS, f"seg(xi, yi, xj, yj) AS (VALUES {_SEGMENTS})", "SELECT cell FROM cells JOIN seg ON (yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / (yj - yi) + xi GROUP BY cell HAVING count(*) % 2 = 1"))
def p8(s, d):
    from ..functions.expr import in_rings

    return V.cells(s, d).filter(in_rings(F.col("x"), F.col("y"), RINGS)).select("cell")


GROUPS = "g AS (SELECT cell, section * 10 + CAST(floor((x + 1000) / 2200) AS INT) AS \"group\" FROM cells)"


def groups(s, d):
    return V.cells(s, d).select("cell", (F.col("section") * 10 + F.floor((F.col("x") + 1000) / 2200).cast("int")).alias("group"))


@query("g6_super_edges", sql(CELLS, CONTACTS, GROUPS, 'SELECT least(p."group", q."group") AS a, greatest(p."group", q."group") AS b, count(*) AS n FROM contacts JOIN g p ON a = p.cell JOIN g q ON b = q.cell WHERE p."group" <> q."group" GROUP BY 1, 2'))
def g6(s, d):
    return G.super_edges(V.contacts(s, d), groups(s, d))


@query("g7_label_transfer", sql(CELLS, CONTACTS, GROUPS, 'SELECT a, b, (least(p."group", q."group") * 31 + greatest(p."group", q."group")) % 5 AS label FROM contacts JOIN g p ON a = p.cell JOIN g q ON b = q.cell WHERE p."group" <> q."group"'))
def g7(s, d):
    g = groups(s, d)
    labels = G.super_edges(V.contacts(s, d), g).select(F.col("a").alias("ga"), F.col("b").alias("gb"), ((F.col("a") * 31 + F.col("b")) % 5).alias("label"))
    met = V.contacts(s, d).join(g.select(F.col("cell").alias("a"), F.col("group").alias("g1")), "a").join(g.select(F.col("cell").alias("b"), F.col("group").alias("g2")), "b")
    met = met.withColumn("ga", F.least("g1", "g2")).withColumn("gb", F.greatest("g1", "g2"))
    return met.join(labels, ["ga", "gb"]).select("a", "b", "label")


@query("m9_components", "WITH RECURSIVE " + ",\n".join([CELLS, CONTACTS, BOTH]) + ", walk AS (SELECT cell AS src, cell AS dst FROM cells UNION SELECT w.src, e.dst FROM walk w JOIN ends e ON w.dst = e.src) SELECT src AS cell, min(dst) AS component FROM walk GROUP BY 1")
def m9(s, d):
    return G.components(V.contacts(s, d), V.cells(s, d))


@query("m13_k_core")
def m13(s, d):
    return G.k_core(G.undirected(G.radius(V.cells(s, d), 800.0, 8)), 4)


@query("m14_shared_neighbours", sql(CELLS, CONTACTS, BOTH, "SELECT p.src AS a, q.src AS b, count(*) AS shared FROM ends p JOIN ends q ON p.dst = q.dst WHERE p.src < q.src GROUP BY 1, 2 HAVING count(*) >= 3"))
def m14(s, d):
    return G.shared_neighbours(V.contacts(s, d), 3)


@query("g33_median_contact_length", sql(CELLS, CONTACTS, "SELECT section, round(list_sort(list(distance))[count(*) // 2 + 1], 6) AS length FROM contacts GROUP BY 1"))
def g33(s, d):
    from ..operators.stats import upper_median_by

    return upper_median_by(V.contacts(s, d), ["section"], "distance", "length").withColumn("length", F.round("length", 6))


@query("g47_tile_pyramid", sql(CELLS, "t AS (SELECT l, section, CAST(floor(x / (500 * power(2, l))) AS BIGINT) AS tx, CAST(floor(y / (500 * power(2, l))) AS BIGINT) AS ty, kind, count(*) AS n FROM cells, range(0, 4) r(l) GROUP BY ALL)", "SELECT CAST(l AS INT) AS level, section, tx, ty, kind, n FROM t"))
def g47(s, d):
    from ..operators.pool import pyramid

    return pyramid(V.cells(s, d), 500.0, 4)


@query("g48_bounds", sql(CELLS, "SELECT section, min(x) AS x0, max(x) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, count(*) AS n FROM cells GROUP BY 1"))
def g48(s, d):
    return V.cells(s, d).groupBy("section").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.round(F.min("y"), 6).alias("y0"), F.round(F.max("y"), 6).alias("y1"), F.count(F.lit(1)).alias("n"))


@query("m10_auto_batch", "WITH RECURSIVE " + ",\n".join([CELLS, CONTACTS, BOTH]) + ", walk AS (SELECT cell AS src, cell AS dst FROM cells UNION SELECT w.src, e.dst FROM walk w JOIN ends e ON w.dst = e.src), comp AS (SELECT src AS cell, min(dst) AS component FROM walk GROUP BY 1) SELECT component, count(*) AS n, min(x) AS x0, max(x) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, dense_rank() OVER (ORDER BY component) AS batch FROM comp JOIN cells USING (cell) GROUP BY 1")
def m10(s, d):
    from pyspark.sql import Window as W

    got = G.components(V.contacts(s, d), V.cells(s, d)).join(V.cells(s, d), "cell").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.round(F.min("y"), 6).alias("y0"), F.round(F.max("y"), 6).alias("y1"))
    return got.withColumn("batch", F.dense_rank().over(W.orderBy("component")).cast("long"))
