"""Sums over sparse counts: totals, moments with zeros, pseudobulk, memberships, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import log_cp10k, x_ln_x
from . import graph


def collected(rows: DataFrame, most: int) -> list[Row]:
    """All rows, on the driver; more than `most` raise an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows to collect")
    return got


def totals(counts: DataFrame, by: str) -> DataFrame:
    return counts.groupBy(by).agg(F.sum("count").alias("total"))


def with_total(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", F.sum("count").over(W.partitionBy("cell")))


def normalised(counts: DataFrame) -> DataFrame:
    """cell, feature, value = log CP10k. Zeros stay absent: their value is 0."""
    return with_total(counts).select("cell", "feature", log_cp10k(F.col("count"), F.col("total")).alias("value"))


def moments(counts: DataFrame, n_cells: Column | int, by: str = "feature", value: str = "count") -> DataFrame:
    """mean, variance (n - 1) and detected of each feature over all cells, absent rows counting as zeros."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    s, q = F.sum(value), F.sum(F.col(value) * F.col(value))
    out = counts.groupBy(by).agg(s.alias("s"), q.alias("q"), F.count(F.when(F.col(value) > 0, 1)).alias("detected"))
    return out.select(by, (F.col("s") / n).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("variance"), "detected")


def pseudobulk(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """group, feature, count."""
    return counts.join(groups, "cell").groupBy("group", "feature").agg(F.sum("count").alias("count"))


def membership(edges: DataFrame) -> DataFrame:
    """cell, community, share: what part of a cell's contacts is of each community. edges: a, b, community."""
    ends = graph.endpoints(edges, "community").groupBy("cell", "community").agg(F.count(F.lit(1)).alias("n"))
    return ends.select("cell", "community", (F.col("n") / F.sum("n").over(W.partitionBy("cell"))).alias("share"))


def dominant(shares: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, cluster: the community of the largest share, ties to the least id; 0 for a cell without contacts."""
    best = shares.groupBy("cell").agg(F.max(F.struct("share", (-F.col("community")).alias("c"))).alias("b"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.coalesce(-F.col("b.c"), F.lit(0)).alias("cluster"))


def entropy(shares: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, entropy in nats; NaN for a cell without contacts."""
    h = shares.groupBy("cell").agg((-F.sum(x_ln_x(F.col("share")))).alias("h"))
    return cells.select("cell").join(h, "cell", "left").select("cell", F.coalesce("h", F.lit(float("nan"))).alias("entropy"))


def feature_community(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """feature, community, exposure, total, mean: membership-weighted sums with a Gamma(1, 1) posterior mean."""
    met = counts.join(shares, "cell").groupBy("feature", "community").agg(F.sum(F.col("count") * F.col("share")).alias("total"))
    exposure = shares.groupBy("community").agg(F.sum("share").alias("exposure"))
    return met.join(exposure, "community").select("feature", "community", "exposure", "total", ((1 + F.col("total")) / (1 + F.col("exposure"))).alias("mean"))


def community_stats(edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """community, feature, total of the edges' pooled profiles (a, b, feature, count)."""
    return profiles.join(edges.select("a", "b", "community"), ["a", "b"]).groupBy("community", "feature").agg(F.sum("count").alias("total"))


def plug_in_score(stats: DataFrame) -> DataFrame:
    """score = sum f(D) - sum f(V) with f(x) = x ln x, and the mutual information in nats."""
    d = stats.agg(F.sum(x_ln_x(F.col("total"))).alias("fd"), F.sum("total").alias("n"))
    v = stats.groupBy("community").agg(F.sum("total").alias("v")).agg(F.sum(x_ln_x(F.col("v"))).alias("fv"))
    g = stats.groupBy("feature").agg(F.sum("total").alias("g")).agg(F.sum(x_ln_x(F.col("g"))).alias("fg"))
    one = d.join(v).join(g)  # three tables of one row
    return one.select((F.col("fd") - F.col("fv")).alias("score"), ((F.col("fd") - F.col("fv") - F.col("fg") + x_ln_x(F.col("n"))) / F.col("n")).alias("mutual_information"), F.col("n").alias("total_mass"))


def group_levels(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """group, feature, level: the mean log CP10k over all cells of the group."""
    n = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    s = normalised(counts).join(groups, "cell").groupBy("group", "feature").agg(F.sum("value").alias("s"))
    return s.join(n, "group").select("group", "feature", (F.col("s") / F.col("n")).alias("level"))


def markers(rates: DataFrame, floor: float, n: int) -> DataFrame:
    """group, feature, fold, rank: the n features with the largest (rate + floor) / (mean of other groups + floor)."""
    k = F.count(F.lit(1)).over(W.partitionBy("feature"))
    other = (F.sum("level").over(W.partitionBy("feature")) - F.col("level")) / F.greatest(k - 1, F.lit(1))
    fold = rates.withColumn("fold", (F.col("level") + floor) / (other + floor))
    return fold.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(F.desc("fold"), "feature"))).filter(F.col("rank") <= n).select("group", "feature", "fold", "rank")


def pyramid(cells: DataFrame, width: float, levels: int) -> DataFrame:
    """level, section, tx, ty, kind, n: counts by tile and kind, tiles twice as wide at each level."""
    out = None
    base = cells.select("section", "kind", F.floor(F.col("x") / width).alias("tx"), F.floor(F.col("y") / width).alias("ty")).groupBy("section", "kind", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    for level in range(levels):
        rows = base.groupBy("section", "kind", F.floor(F.col("tx") / 2**level).alias("tx"), F.floor(F.col("ty") / 2**level).alias("ty")).agg(F.sum("n").alias("n"))
        rows = rows.select(F.lit(level).alias("level"), "section", "tx", "ty", "kind", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def highly_variable(counts: DataFrame, n_cells: int, n: int, bins: int = 5) -> DataFrame:
    """feature, dispersion, z, rank: ln(variance / mean), z-scored within bins of equal numbers by mean."""
    m = moments(counts, n_cells).filter("mean > 0 AND variance > 0")
    m = m.withColumn("dispersion", F.log(F.col("variance") / F.col("mean"))).withColumn("bin", F.ntile(bins).over(W.orderBy("mean", "feature")))
    w = W.partitionBy("bin")
    z = m.withColumn("z", (F.col("dispersion") - F.avg("dispersion").over(w)) / F.stddev_samp("dispersion").over(w))
    return z.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("z"), "feature"))).filter(F.col("rank") <= n).select("feature", "dispersion", "z", "rank")
