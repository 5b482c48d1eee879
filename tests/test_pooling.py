from pairloom.operators import graph


def test_sums_by_contact_equal_plain_sums_and_need_no_shuffle_of_exploded_rows(spark):
    edges = spark.createDataFrame([(1, 2, 7), (1, 3, 7), (2, 4, 8), (4, 5, 8)], "a long, b long, section int")
    rows = [(1, "f", 2.0), (2, "f", 5.0), (2, "g", 1.0), (3, None, 4.0), (4, "g", None)]
    counts = spark.createDataFrame(rows, "cell long, feature string, count double")
    want = {}
    for e in edges.collect():
        for cell, f, x in rows:
            if cell in (e.a, e.b):
                one = want.setdefault((e.a, e.b, e.section, f), [0.0, 0.0])
                one[cell == e.b] += x or 0.0
    got = {(r.a, r.b, r.section, r.feature): (r.shared, r.difference) for r in graph.shared_difference(edges, counts, "section").collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == {k: (l + r, abs(l - r)) for k, (l, r) in want.items() if (k[0], k[1], k[3]) != (4, 5, "g")}
    pooled = graph.pool_endpoints(edges, counts).collect()
    assert {(r.a, r.b, r.feature): r["count"] for r in pooled if r["count"] is not None} == {(a, b, f): l + r for (a, b, _, f), (l, r) in want.items() if (a, b, f) != (4, 5, "g")}
    assert {(r.a, r.b, r.feature) for r in pooled} == {(a, b, f) for a, b, _, f in want}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = graph.pool_endpoints(edges, counts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(a" in plan and "feature" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_the_most_counted_feature_of_a_contact_needs_no_exploded_rows(spark):
    from pyspark.sql import functions as F

    edges = spark.createDataFrame([(1, 2, 7), (1, 3, 7), (2, 4, 8), (4, 5, 8), (5, 6, 8)], "a long, b long, section int")
    rows = [(1, "f", 2.0), (1, "g", 3.0), (2, "f", 1.0), (3, None, 9.0), (4, "g", 1.0), (4, "f", None)]
    counts = spark.createDataFrame(rows, "cell long, feature string, count double")
    got = graph.most_counted(edges, counts, "section")
    assert {(r.a, r.b): r.feature for r in got.collect()} == {(1, 2): "g", (1, 3): None, (2, 4): "g", (4, 5): "g"}
    want = graph.pool_endpoints(edges, counts, "section").groupBy("a", "b", "section").agg(F.max(F.struct("count", "feature"))["feature"].alias("feature"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert "explode" not in got._jdf.queryExecution().executedPlan().toString().lower()
