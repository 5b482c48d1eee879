"""Ligand-receptor scores over contacts: strata, contact tables, doses, spatial lags, verdicts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import classify_contact, jeffreys_log_odds
from ..session import cut
from . import graph

#: Shuffles of a task that are drawn one after another, after those of the tasks before it.
DRAWN = 512


def strata(edges: DataFrame) -> DataFrame:
    """a, b, community of the contacts whose two cells have the same community (the mode of a cell's contacts)."""
    modes = graph.majority(graph.endpoints(edges, "community"), "cell", F.col("community"))
    one = modes.select(F.col("cell").alias("a"), F.col("label").alias("ca"))
    two = modes.select(F.col("cell").alias("b"), F.col("label").alias("cb"))
    return edges.select("a", "b").join(one, "a").join(two, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("community"))


def detected(edges: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, community, ligand, receptor, l_a, r_a, l_b, r_b: contacts where one end detects one gene of a pair.

    Only cells that detect something are joined; contacts that are silent for a pair are not listed.
    """
    genes = counts.filter("count > 0").select("cell", "feature")
    has = genes.join(pairs.select(F.col("ligand").alias("feature"), "ligand", "receptor"), "feature").select("cell", "ligand", "receptor", F.lit(1).alias("l"), F.lit(0).alias("r"))
    has = has.unionByName(genes.join(pairs.select(F.col("receptor").alias("feature"), "ligand", "receptor"), "feature").select("cell", "ligand", "receptor", F.lit(0).alias("l"), F.lit(1).alias("r")))
    has = has.groupBy("cell", "ligand", "receptor").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    met = graph.endpoints(edges, "community").join(has, "cell")

    def side(end: str, gene: str) -> Column:
        return (F.max(F.when(F.col("cell") == F.col(end), F.col(gene)).otherwise(0)) == 1).alias(f"{gene}_{end}")

    return met.groupBy("a", "b", "community", "ligand", "receptor").agg(*[side(e, g) for e in "ab" for g in "lr"])


def coexpression_scores(edges: DataFrame, counts: DataFrame, pairs: DataFrame, depth: DataFrame) -> DataFrame:
    """community, ligand, receptor and the contact table's scores. edges: a, b, community; depth: cell, depth.

    Contacts count from both ends. role_purity: the mean over cells of |sent - received| / (sent + received).
    """
    d = detected(edges, counts, pairs)
    kind = classify_contact(*[F.col(c) for c in ("l_a", "r_a", "l_b", "r_b")])
    d = d.withColumn("kind", kind)

    def n(*columns):
        return sum((F.col(c).cast("long") for c in columns), F.lit(0))

    joint = (F.col("l_a") & F.col("r_b")).cast("long") + (F.col("l_b") & F.col("r_a")).cast("long")
    table = d.groupBy("community", "ligand", "receptor").agg(F.sum(joint).alias("n11"), F.sum(n("l_a", "l_b")).alias("n_l"), F.sum(n("r_a", "r_b")).alias("n_r"), F.count(F.when(F.col("kind") == "mutual", 1)).alias("n_mutual"), F.count(F.when(F.col("kind") == "oneway", 1)).alias("n_oneway"))
    forth, back = F.col("l_a") & F.col("r_b"), F.col("l_b") & F.col("r_a")
    roles = d.filter("kind <> 'silent'").select("community", "ligand", "receptor", F.explode(F.array(F.struct(F.col("a").alias("cell"), forth.alias("sent"), back.alias("got")), F.struct(F.col("b").alias("cell"), back.alias("sent"), forth.alias("got")))).alias("x"))
    roles = roles.groupBy("community", "ligand", "receptor", "x.cell").agg(F.sum(F.col("x.sent").cast("int")).alias("s"), F.sum(F.col("x.got").cast("int")).alias("r"))
    purity = roles.groupBy("community", "ligand", "receptor").agg(F.avg(F.abs(F.col("s") - F.col("r")) / (F.col("s") + F.col("r"))).alias("role_purity"))
    size = edges.groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"))
    mean = graph.endpoints(edges, "community").select("community", "cell").distinct().join(depth, "cell").groupBy("community").agg(F.avg("depth").alias("mean_log_depth"))
    key = ["community", "ligand", "receptor"]
    full = size.join(mean, "community").join(F.broadcast(pairs)).join(table, key, "left").join(purity, key, "left")
    full = full.na.fill(0, ["n11", "n_l", "n_r", "n_mutual", "n_oneway"]).withColumn("n", 2 * F.col("n_edges"))
    value, se = jeffreys_log_odds(*[F.col(c) for c in ("n11", "n_l", "n_r", "n")])
    return full.select(*key, "n_edges", "mean_log_depth", (F.col("n_l") / F.col("n")).alias("lig_rate"), (F.col("n_r") / F.col("n")).alias("rec_rate"), "n_mutual", "n_oneway", F.coalesce("role_purity", F.lit(float("nan"))).alias("role_purity"), value.alias("log_or"), se.alias("log_or_se"))


def contact_dose(edges: DataFrame, counts: DataFrame, feature: str, factors: DataFrame) -> DataFrame:
    """cell, dose: the sum over contacts of the ligand over the neighbour's size factor; 0 without."""
    value = counts.filter(F.col("feature") == feature).join(factors, "cell").select("cell", (F.col("count") / F.col("size_factor")).alias("v"))
    return graph.neighbour_sum(edges, value, "v").select(F.col("src").alias("cell"), F.col("total").alias("dose"))


def choose_threshold(doses: DataFrame, least: int) -> DataFrame:
    """tau: 0 if both arms of dose > 0 have `least` cells; else the upper median, stepped down below ties if needed."""
    from .stats import upper_median_by

    one = doses.agg(F.count(F.when(F.col("dose") > 0, 1)).alias("above"), F.count(F.lit(1)).alias("n"))
    med = upper_median_by(doses, [], "dose", "med")
    below = doses.join(F.broadcast(med)).filter("dose < med").agg(F.max("dose").alias("under"))
    top = doses.join(F.broadcast(med)).agg(F.count(F.when(F.col("dose") > F.col("med"), 1)).alias("over"))
    met = one.join(med).join(below).join(top)  # tables of one row
    zero = (F.col("above") >= least) & (F.col("n") - F.col("above") >= least)
    return met.select(F.when(zero, 0.0).when(F.col("over") >= least, F.col("med")).otherwise(F.coalesce("under", F.lit(0.0))).alias("tau"))


def bivariate_moran(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One row: the row-standardised lag product of x at a cell and y around it, over centred values (cell, x, y)."""
    c = values.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    z = values.join(F.broadcast(c)).select("cell", ((F.col("x") - F.col("mx")) / F.col("sx")).alias("zx"), ((F.col("y") - F.col("my")) / F.col("sy")).alias("zy"))
    lag = graph.neighbour_sum(edges, z, "zy").select(F.col("src").alias("cell"), F.col("mean").alias("lag"))
    return z.join(lag, "cell").agg(F.avg(F.col("zx") * F.col("lag")).alias("moran"))


def moran_by_feature(edges: DataFrame, values: DataFrame, n_cells: int) -> DataFrame:
    """feature, moran: (N / W) sum_ij z_i z_j / sum z^2 over contacts from both ends; absent values are 0.

    Centred sums are expanded, so only the sparse values are joined: sum (x_i - m)(x_j - m) over ends.
    """
    ends = graph.both_ways(edges)
    w = ends.count()
    cross = ends.join(values.select(F.col("cell").alias("src"), "feature", F.col("value").alias("x")), "src").join(values.select(F.col("cell").alias("dst"), "feature", F.col("value").alias("y")), ["dst", "feature"])
    cross = cross.groupBy("feature").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    degree = ends.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    side = values.join(degree.withColumnRenamed("src", "cell"), "cell", "left").groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.sum(F.col("value") * F.coalesce("deg", F.lit(0))).alias("sd"))
    m = F.col("s") / n_cells
    top = F.coalesce("xy", F.lit(0.0)) - 2 * m * F.col("sd") + m * m * w
    bottom = F.col("q") - n_cells * m * m
    return side.join(cross, "feature", "left").select("feature", F.when(bottom > 1e-12, n_cells / w * top / bottom).otherwise(0.0).alias("moran"))


def permuted_moran(edges: DataFrame, cells: DataFrame, counts: DataFrame, perms: int, seed: int) -> DataFrame:
    """feature, moran, null_mean, null_sd, p: Moran's I of each feature against shuffles of whole cells within sections.

    edges: a, b; cells: cell, section; counts: cell, feature, count. All features share a shuffle, drawn one after another from
    (seed, section) alone; tasks hold a section's contacts, a block of features and a range of shuffles (see permute).
    p = (1 + shuffles at or above the observed) / (1 + perms); it is NaN for a feature that does not vary.
    """
    from . import permute

    placed = permute.placed(edges, cells, counts)
    sums = permute.shuffled_sums(placed, permute.streamed(seed), 0, perms + 1, DRAWN)
    value = permute.moran(placed.cells, 2 * placed.links)
    got = cut(sums.join(F.broadcast(placed.side()), "at").select("feature", "perm", value.alias("v")))
    seen = got.filter("perm = 0").select("feature", F.col("v").alias("moran"))
    null = got.filter("perm > 0").join(F.broadcast(seen), "feature")
    above = F.count(F.when(F.col("v") >= F.col("moran") - 1e-9 * F.abs("moran") - 1e-12, 1))
    p = F.when(F.isnan(F.first("moran")), float("nan")).otherwise((1 + above) / (1 + perms))
    return null.groupBy("feature").agg(F.first("moran").alias("moran"), F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_sd"), p.alias("p"))


def celltype_scores(kinds: DataFrame, counts: DataFrame, pairs: DataFrame, least: float = 0.1) -> DataFrame:
    """ligand, receptor, sender, receiver, score: mean ligand times mean receptor, where both are detected in a share of `least`."""
    n = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    m = counts.join(kinds, "cell").groupBy("kind", "feature").agg(F.sum("count").alias("s"), F.count(F.when(F.col("count") > 0, 1)).alias("k")).join(n, "kind")
    m = m.select("kind", "feature", (F.col("s") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("share")).filter(F.col("share") >= least)
    send = m.select(F.col("kind").alias("sender"), F.col("feature").alias("ligand"), F.col("mean").alias("ml"))
    get = m.select(F.col("kind").alias("receiver"), F.col("feature").alias("receptor"), F.col("mean").alias("mr"))
    return pairs.join(send, "ligand").join(get, "receptor").select("ligand", "receptor", "sender", "receiver", (F.col("ml") * F.col("mr")).alias("score"))


def overlap_effect(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, theta, n, n_treated, mean_h, ess from rows with treated (0/1), e, m0, m1 and y: the augmented overlap-weighted effect."""
    e, m0, m1, y = (F.col(c) for c in ("e", "m0", "m1", "y"))
    h = e * (1 - e)
    term = F.when(F.col("treated") == 1, h * (m1 - m0) + (1 - e) * (y - m1)).otherwise(h * (m1 - m0) - e * (y - m0))
    n = F.count(F.lit(1))
    arms = (F.sum("treated") > 0) & (F.sum("treated") < n) & (F.sum(h) > 1e-12)
    return rows.groupBy(*by).agg(F.when(arms, F.sum(term) / F.sum(h)).otherwise(F.lit(float("nan"))).alias("theta"), n.alias("n"), F.sum("treated").alias("n_treated"), F.avg(h).alias("mean_h"), (F.sum(h) * F.sum(h) / F.sum(h * h)).alias("ess"))


def _usable(estimates: DataFrame) -> DataFrame:
    """Estimates with a finite theta and se and positive degrees of freedom."""
    infinite = F.lit(float("inf"))
    return estimates.filter((F.abs("theta") < infinite) & (F.abs("se") < infinite) & (F.col("df") > 0) & ~F.isnan("df"))


def rubin(estimates: DataFrame, by: list[str]) -> DataFrame:
    """by, theta, se, df of several usable estimates (theta, se, df) of one thing, within and between; Barnard-Rubin degrees.

    NaN for groups without a usable estimate (but degrees 0, the mark of one cluster, if all have it); one
    estimate keeps its degrees. Without a spread between
    estimates the degrees are the observed-data ones alone; infinite degrees leave those of the spread.
    """
    r = F.count(F.lit(1))
    mean, within = F.avg("theta"), F.avg(F.col("se") * F.col("se"))
    between = F.when(r > 1, F.var_samp("theta")).otherwise(0.0)
    got = _usable(estimates).groupBy(*by).agg(r.alias("r"), mean.alias("theta"), within.alias("u"), between.alias("b"), F.min("df").alias("nu"))
    total = F.col("u") + (1 + 1 / F.col("r")) * F.col("b")
    lam = F.when(total > 0, (1 + 1 / F.col("r")) * F.col("b") / total).otherwise(0.0)
    old = (F.col("r") - 1) / (lam * lam)
    infinite = F.col("nu") == float("inf")
    seen = F.when(infinite, F.col("nu")).otherwise((F.col("nu") + 1) / (F.col("nu") + 3) * F.col("nu") * (1 - lam))
    both = F.when(infinite, old).otherwise(old * seen / (old + seen))
    df = F.when(F.col("r") < 2, F.col("nu")).when(lam > 0, both).otherwise(seen)
    out = got.select(*by, "theta", F.sqrt(total).alias("se"), df.alias("df"))
    none = F.lit(float("nan"))
    groups = estimates.groupBy(*by).agg(F.when((F.min("df") == 0) & (F.max("df") == 0), 0.0).otherwise(none).alias("lone"))
    return groups.join(out, by, "left").select(*by, F.coalesce("theta", none).alias("theta"), F.coalesce("se", none).alias("se"), F.coalesce("df", "lone").alias("df"))


def abf_average(estimates: DataFrame, by: list[str], scale: float = 10.0) -> DataFrame:
    """by, theta, se, df averaged with Wakefield weights over usable estimates of positive se.

    Prior variance W = scale^2 times the upper median of se^2, shrinkage W / (se^2 + W); weights
    exp(log BF - max). One estimate is itself; a group without any is combined by rubin().
    """
    from .stats import upper_median_by

    ok = _usable(estimates).filter("se > 0").withColumn("v", F.col("se") * F.col("se"))
    met = ok.join(upper_median_by(ok, by, "v", "vm"), by)
    prior = scale * scale * F.col("vm")
    r = prior / (F.col("v") + prior)
    z2 = F.col("theta") * F.col("theta") / F.col("v")
    met = met.withColumn("lbf", 0.5 * F.log(F.col("v") / (F.col("v") + prior)) + 0.5 * z2 * r)
    w = W.partitionBy(*by)
    met = met.withColumn("w", F.exp(F.col("lbf") - F.max("lbf").over(w)))
    met = met.withColumn("w", F.col("w") / F.sum("w").over(w)).withColumn("mean", F.sum(F.col("w") * F.col("theta")).over(w))
    gap = F.col("theta") - F.col("mean")
    got = met.groupBy(*by).agg(F.first("mean").alias("theta"), F.sqrt(F.sum(F.col("w") * (F.col("v") + gap * gap))).alias("se"), F.sum(F.col("w") / F.col("df")).alias("d"))
    got = got.select(*by, "theta", "se", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(float("inf")).alias("df"))
    return got.unionByName(rubin(estimates.join(got.select(*by), by, "left_anti"), by))


def tile_jackknife(rows: DataFrame, by: list[str], tile: str, num: str, den: str) -> DataFrame:
    """by, theta, se: a ratio of sums and its delete-one-tile jackknife, from tile sums alone."""
    t = rows.groupBy(*by, tile).agg(F.sum(num).alias("tn"), F.sum(den).alias("td"))
    w = W.partitionBy(*by)
    t = t.withColumn("n", F.sum("tn").over(w)).withColumn("d", F.sum("td").over(w))
    t = t.withColumn("v", (F.col("n") - F.col("tn")) / (F.col("d") - F.col("td")))
    g = F.count(F.lit(1))
    return t.groupBy(*by).agg((F.first("n") / F.first("d")).alias("theta"), F.when(g > 1, F.sqrt((g - 1) * F.var_pop("v"))).otherwise(F.lit(float("nan"))).alias("se"))


def verdicts(obs: np.ndarray, null: np.ndarray, varies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, p and family-wise p by Westfall-Young minima of each column of null (shuffles x pairs); NaN where there is no spread."""
    perms, sd = len(null), null.std(0)
    spread = varies & (sd > 0)
    p = np.where(spread, ((null > obs).sum(0) + 0.5 * (null == obs).sum(0) + 0.5) / (perms + 1), np.nan)
    ranks = (null.argsort(0).argsort(0) + 0.5) / perms
    least = (1 - ranks[:, spread]).min(1, initial=1)
    fwer = np.where(spread, (1 + (least[:, None] <= p[None, :]).sum(0)) / (perms + 1), np.nan)
    z = np.where(spread, (obs - null.mean(0)) / np.where(spread, sd, 1), np.nan)
    return z, p, fwer


def permutation_test(strata_values: DataFrame, perms: int, seed: int) -> DataFrame:
    """stratum, pair, stat, z, p_empirical, fwer: covariances over contacts with shared permutations and Westfall-Young minima.

    strata_values: stratum, pairs: array of struct(pair, l: array, r: array) - one row per stratum, as
    the minima need all pairs of a stratum together. Draws depend on (seed, stratum) alone. A pair whose
    null has no spread (a side is constant) has NaN and does not enter the minima.
    """
    schema = "stratum long, pair string, stat double, z double, p_empirical double, fwer double"

    def each(batches):
        for b in batches:
            for stratum, pairs in zip(b.column("stratum").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                rng = np.random.default_rng([seed, stratum])
                l, r = (np.array([p[c] for p in pairs], np.float64) for c in "lr")
                l, r = l - l.mean(1, keepdims=True), r - r.mean(1, keepdims=True)
                obs = (l * r).mean(1)
                null = np.empty((perms, len(pairs)))
                for k in range(perms):
                    null[k] = (l * r[:, rng.permutation(r.shape[1])]).mean(1)
                z, p, fwer = verdicts(obs, null, null.std(0) > 0)
                yield pa.record_batch([pa.array([stratum] * len(pairs)), pa.array([x["pair"] for x in pairs]), pa.array(obs), pa.array(z), pa.array(p), pa.array(fwer)], names=["stratum", "pair", "stat", "z", "p_empirical", "fwer"])

    return strata_values.mapInArrow(each, schema)


def upper_normal_p(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta function's continued fraction, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t, the normal's for infinite degrees; NaN stays NaN."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(df):
        return 2 * upper_normal_p(abs(t))
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_crit_975(df: float) -> float:
    """The upper 2.5 % point of Student's t, the normal's for infinite degrees; NaN for none."""
    if math.isnan(df) or df <= 0:
        return float("nan")
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 0.05:
        low, high = high, 2 * high
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_two_sided(middle, df) > 0.05 else (low, middle)
    return (low + high) / 2


def with_p(df: DataFrame, t: str, degrees: str, out: str) -> DataFrame:
    """A column of two-sided p values, computed in Arrow batches."""

    @F.pandas_udf("double")
    def p(a, b):  # two series
        return a.combine(b, t_two_sided)

    return df.withColumn(out, p(F.col(t), F.col(degrees)))
