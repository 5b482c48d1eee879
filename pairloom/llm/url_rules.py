"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every URL is expanded into its host suffixes times the prefixes of its path that have a length some
rule has. An expression's digest is SHA-256; the join is on the digest's first four bytes, and a
match counts only if all 32 bytes agree. Of the confirmed rules the longest (host and path
together) decides. Only DataFrame functions are used.

A null URL, or one without "://", has an empty host and path and fits no rule. Repeated rows stay
repeated; extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT = "allow"
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), *_ASCII)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _digest(host_: Column, path_: Column) -> Column:
    return F.sha2(F.concat(host_, F.lit("\n"), path_), 256)


def judge(pages: DataFrame, rules: DataFrame, path_lengths: list[int], default: str = DEFAULT) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of pages (page_id, url).

    rules: host, path, verdict. path_lengths: the lengths of path that rules have.
    Two rules with the same host and path: block wins. The planner broadcasts the rules only while
    they are under its size limit; beyond it both sides are shuffled by hash prefix, and adaptive
    execution splits the prefixes of frequent suffixes.
    """
    rows = pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("page_id", "url", "copies", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(set(path_lengths))])
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(F.array_compact(prefixes), lambda p: F.concat(h, F.lit("\n"), p))))
    wide = rows.withColumn("expr", F.explode_outer(F.when(F.col("host") != "", both)))
    wide = wide.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, 8))
    known = rules.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("block"))
    known = known.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, 8).alias("short"),
        _digest(F.col("host"), F.col("path")).alias("full"),
        F.concat("host", "path").alias("rule"),
        F.when(F.col("block") == 1, "block").otherwise("allow").alias("said"),
        (F.length("host") + F.length("path")).alias("size"),
    )
    met = wide.join(known, "short", "left").withColumn("fits", F.col("full") == F.col("digest"))
    best = F.max(F.when(F.col("fits"), F.struct("size", "rule", "said"))).alias("best")
    out = met.groupBy("page_id", "url").agg(F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    out = out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_table(spark), [len(r[1]) for r in RULES]).drop("url")


SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
        translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rh, rp, said) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
k AS (SELECT row_number() OVER () AS rid, * FROM p),
m AS (SELECT rid, rh || rp AS rule, said, row_number() OVER (PARTITION BY rid ORDER BY length(rh) + length(rp) DESC) AS n
      FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict
FROM k LEFT JOIN (SELECT rid, rule, said FROM m WHERE n = 1) USING (rid)
"""
QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": SQL}
