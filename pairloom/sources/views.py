"""The model's tables as views over the driver's: cells with coordinates, sparse counts, features, contacts.

counts is a long sparse relation: a missing row is a zero of a measured feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, x, y, section, donor, kind."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    out = table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    y = (F.coalesce(F.col("s"), F.lit(0).cast("decimal(28,2)")).cast("double") / 1000).alias("y")
    return out.select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("x"), y, F.col("c_nationkey").alias("section"), F.col("n_regionkey").alias("donor"), F.col("c_mktsegment").alias("kind"))


def counts(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """cell, feature, count: what a customer bought of a brand (or of a brand in a size)."""
    feature = F.concat_ws("|", "p_brand", F.col("p_size").cast("string")) if fine else F.col("p_brand")
    part = table(spark, sf_dir, "part").select("p_partkey", feature.alias("feature"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    met = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("cell", "feature").agg(F.sum("l_quantity").alias("count"))


def contacts(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """a, b (a < b), distance, section: the union of k nearest neighbours within sections."""
    return graph.undirected(graph.knn(cells(spark, sf_dir), k))


def pairs(spark: SparkSession) -> DataFrame:
    """ligand, receptor: neighbouring brands."""
    rows = [(f"Brand#{a}{b}", f"Brand#{a}{b % 5 + 1}") for a in range(1, 6) for b in range(1, 6)]
    return spark.createDataFrame(rows, "ligand string, receptor string")


def communities(spark: SparkSession, sf_dir: str, n: int = 4, k: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """a, b, distance, section, community: the contact's most counted brand, by number modulo n. edges: contacts(), where these are at hand."""
    found = contacts(spark, sf_dir, k) if edges is None else edges
    best = graph.most_counted(found, counts(spark, sf_dir), "distance", "section")
    number = F.regexp_extract("feature", r"(\d+)", 1).cast("int")
    return best.select("a", "b", "distance", "section", F.pmod(number, F.lit(n)).alias("community"))


CELLS = """cells AS (SELECT c_custkey AS cell, c_acctbal AS x, CAST(coalesce(s, 0) AS DOUBLE) / 1000 AS y, c_nationkey AS section, n_regionkey AS donor, c_mktsegment AS kind
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
COUNTS = """counts AS (SELECT o_custkey AS cell, p_brand AS feature, sum(l_quantity) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
FINE = """counts AS (SELECT o_custkey AS cell, p_brand || '|' || CAST(p_size AS VARCHAR) AS feature, sum(l_quantity) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
CONTACTS = """near AS (SELECT p.cell AS a, q.cell AS b, p.section, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS distance,
    row_number() OVER (PARTITION BY p.cell ORDER BY sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.cell) AS rank
  FROM cells p JOIN cells q ON p.section = q.section AND p.cell <> q.cell),
contacts AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(distance) AS distance, min(section) AS section FROM near WHERE rank <= 5 GROUP BY 1, 2)"""
BOTH = "ends AS (SELECT a AS src, b AS dst FROM contacts UNION ALL SELECT b, a FROM contacts)"
COMMUNITIES = """pooled AS (SELECT a, b, feature, sum(count) AS count FROM (SELECT a, b, a AS cell FROM contacts UNION ALL SELECT a, b, b FROM contacts) JOIN counts USING (cell) GROUP BY 1, 2, 3),
dominant AS (SELECT a, b, feature, row_number() OVER (PARTITION BY a, b ORDER BY count DESC, feature DESC) AS n FROM pooled),
communities AS (SELECT a, b, distance, section, CAST(regexp_extract(feature, '(\\d+)', 1) AS INT) % 4 AS community FROM contacts JOIN dominant USING (a, b) WHERE n = 1)"""
PAIRS = "pairs AS (SELECT 'Brand#' || i || j AS ligand, 'Brand#' || i || (j % 5 + 1) AS receptor FROM range(1, 6) t(i), range(1, 6) u(j))"


def sql(*parts: str) -> str:
    """WITH the named parts; the last is the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
