"""Permutation test of pairs' co-expression over pseudobulk samples, with shuffles in buckets and draws from Gamma posteriors.

A sample is a batch and a bin of like cells. In a community, a sample's rate of a feature has the posterior
Gamma(A0 + sum of share x count, B0 + sum of share), share being the part of a cell's contacts in the community. The statistic of a pair is
the covariance, weighted by the samples' shares, of posterior mean log rates. Under the null, log rates are drawn anew and the ligand's are
shuffled among samples of one batch whose bins agree in their low SAME bits, so populations of cells stay where they are. Shuffle and draw k
depend on (seed, stratum, k) and (seed, stratum, k, feature) alone: all pairs share them, and it does not matter which task makes them.

Work is dealt by (stratum, chunk of shuffles, block of pairs); a task holds samples x features of its block, at most about NUMBERS. A
stratum is a community in one batch, or, with several batches, also in all of them together. Ranks over shuffles
and minima over pairs (Westfall and Young) are windows and grouped sums.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import keyed_uniform
from ..session import cut
from .numeric import digamma

# The priors of a rate, the bits of a bin that shuffles keep, the least samples of a stratum, the scale of a MAD
A0 = B0 = 1.0
SAME = 4
LEAST = 4
MAD = 1.4826
#: Samples times features that one task holds densely.
NUMBERS = 1 << 21
_psi = np.vectorize(digamma, otypes=[float])
PAIR = ["stratum", "ligand", "receptor"]


def bins(shares: DataFrame, cells: DataFrame, bits: int = 10, seed: int = 0) -> DataFrame:
    """cell, batch, bin: bit j says whether the cell's shares, projected on the j-th random axis, are above the mean over cells; cells: cell, batch.

    An axis has a number in [-1, 1) for each community, drawn by key. Cells without contacts lie at 0 on every axis."""
    n = max(cells.count(), 1)
    axes = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")
    put = shares.join(cells.select("cell"), "cell", "left_semi").select("cell", "community", "share", axes)
    on = put.groupBy("cell", "bit").agg(F.sum(F.col("share") * (2 * keyed_uniform(seed, F.col("community"), F.col("bit")) - 1)).alias("v"))
    mean = on.groupBy("bit").agg((F.sum("v") / n).alias("mean"))
    every = cells.select("cell", axes).join(on, ["cell", "bit"], "left").join(F.broadcast(mean), "bit")  # one row a bit
    code = every.groupBy("cell").agg(F.sum(F.when(F.coalesce("v", F.lit(0.0)) > F.col("mean"), F.expr("shiftleft(1, bit)")).otherwise(0)).alias("bin"))
    return cells.select("cell", F.col("batch").cast("string").alias("batch")).join(code, "cell", "left").select("cell", "batch", F.coalesce("bin", F.lit(0)).cast("int").alias("bin"))


def pseudobulk(counts: DataFrame, shares: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stratum, community, batch, pooled, of, bin, weight of each sample; stratum, of, bin, feature, num of each sum).

    Every sample of a stratum's batches is there, with weight 0 where none of its cells has contacts of the community."""
    placed = cells.select("cell", F.col("batch").alias("of"), "bin")
    samples = cut(placed.select("of", "bin").distinct())
    met = shares.join(placed, "cell")
    held = cut(met.groupBy("community", "of", "bin").agg(F.sum("share").alias("weight")))
    sums = cut(counts.join(met, "cell").groupBy("community", "of", "bin", F.col("feature").cast("string").alias("feature")).agg(F.sum(F.col("share") * F.col("count")).alias("num")))
    single = held.select("community", F.col("of").alias("batch"), F.lit(False).alias("pooled")).distinct()
    strata = single
    if samples.select("of").distinct().limit(2).count() > 1:
        strata = single.unionByName(held.select("community", F.lit("").alias("batch"), F.lit(True).alias("pooled")).distinct())
    strata = strata.withColumn("stratum", F.concat_ws(":", F.when(F.col("pooled"), "all").otherwise("one"), "community", "batch"))
    every = strata.join(samples, F.col("pooled") | (F.col("batch") == F.col("of"))).join(held, ["community", "of", "bin"], "left")  # strata x samples: both are kinds, not cells
    every = every.select("stratum", "community", "batch", "pooled", "of", "bin", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    many = every.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_samples")).filter(F.col("n_samples") >= LEAST)
    every = cut(every.join(many, "stratum"))
    values = every.select("stratum", "community", "of", "bin").join(sums, ["community", "of", "bin"]).select("stratum", "of", "bin", "feature", "num")
    return every, cut(values)


def _order(bucket: np.ndarray, key: list[int]) -> np.ndarray:
    """A permutation of positions within buckets."""
    at = np.lexsort((np.arange(len(bucket)), bucket))
    out = np.empty(len(bucket), int)
    out[at] = np.lexsort((np.random.default_rng(key).random(len(bucket)), bucket))
    return out


def statistics(stratum: str, num: np.ndarray, weight: np.ndarray, bucket: np.ndarray, features: list[str], pairs: np.ndarray, seed: int, first: int, last: int) -> np.ndarray:
    """t of shuffles first <= k < last (0: observed) and pairs (rows of two feature indices). num: features x samples."""
    key, total = zlib.crc32(stratum.encode()), weight.sum()
    names = [zlib.crc32(x.encode()) for x in features]
    out = np.full((last - first, len(pairs)), np.nan)
    if total <= 1e-12:
        return out
    share = weight / total
    for k in range(first, last):
        if k:
            rates = np.array([np.random.default_rng([seed, key, k, x]).standard_gamma(A0 + row) for x, row in zip(names, num, strict=True)])
            logs, order = np.log(rates) - np.log(B0 + weight), _order(bucket, [seed, key, k])
        else:
            logs, order = _psi(A0 + num) - np.log(B0 + weight), np.arange(len(weight))
        left = logs[:, order]
        left, right = left - (left @ share)[:, None], logs - (logs @ share)[:, None]
        out[k - first] = np.einsum("ps,ps,s->p", left[pairs[:, 0]], right[pairs[:, 1]], share)
    return out


def shuffled(samples: DataFrame, values: DataFrame, pairs: DataFrame, perms: int, seed: int, chunk: int = 100) -> DataFrame:
    """stratum, ligand, receptor, perm, t for perm 0 (observed) to perms."""
    many = samples.agg(F.max("n_samples")).first()[0] or 0
    genes = pairs.select(F.explode(F.array("ligand", "receptor")).alias("feature")).distinct().count()
    blocks = max(1, math.ceil(many * genes / NUMBERS))
    dealt = cut(pairs.select("ligand", "receptor", F.pmod(F.xxhash64("ligand", "receptor"), F.lit(blocks)).cast("int").alias("block")))
    starts = F.explode(F.sequence(F.lit(0), F.lit(perms), F.lit(chunk))).alias("first")
    wants = samples.select("stratum").distinct().crossJoin(dealt).select("stratum", "block", starts, "ligand", "receptor")  # strata x pairs: the result's own size
    bucket = F.xxhash64("of", F.col("bin").bitwiseAND((1 << SAME) - 1))
    sides = dealt.select("block", F.explode(F.array("ligand", "receptor")).alias("feature")).distinct()
    base = samples.select("stratum", "of", "bin", bucket.alias("bucket"), "weight", F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("num"))
    base = base.crossJoin(F.broadcast(dealt.select("block").distinct()))  # a number for each block
    rows = values.join(sides, "feature").select("stratum", "of", "bin", F.lit(0).cast("long").alias("bucket"), F.lit(0.0).alias("weight"), "feature", "num", "block")
    sent = base.unionByName(rows).select("*", starts)

    def each(key, v, w):
        nothing = pa.table({"stratum": pa.array([], pa.string()), "ligand": pa.array([], pa.string()), "receptor": pa.array([], pa.string()), "perm": pa.array([], pa.int32()), "t": pa.array([], pa.float64())})
        if not v.num_rows or not w.num_rows:
            return nothing
        stratum, start = key[0].as_py(), key[2].as_py()
        spot = list(zip(v["of"].to_pylist(), v["bin"].to_pylist(), strict=True))
        name, amount = v["feature"].to_pylist(), v["num"].to_numpy()
        given = sorted((s, i) for i, s in enumerate(spot) if name[i] is None)
        at = {s: j for j, (s, _) in enumerate(given)}
        own = [i for _, i in given]
        left, right = w["ligand"].to_pylist(), w["receptor"].to_pylist()
        genes = sorted({*left, *right})
        row = {g: j for j, g in enumerate(genes)}
        num = np.zeros((len(genes), len(own)))
        for i, g in enumerate(name):
            if g is not None:
                num[row[g], at[spot[i]]] = amount[i]
        which = np.array([[row[a], row[b]] for a, b in zip(left, right, strict=True)])
        last = min(start + chunk, perms + 1)
        t = statistics(stratum, num, v["weight"].to_numpy()[own], v["bucket"].to_numpy()[own], genes, which, seed, start, last)
        k = last - start
        return pa.table({"stratum": pa.array([stratum] * t.size), "ligand": left * k, "receptor": right * k, "perm": pa.array(np.repeat(np.arange(start, last, dtype=np.int32), len(left))), "t": t.ravel()})

    wants = wants.select(F.col("stratum").alias("s"), F.col("block").alias("b"), F.col("first").alias("f"), "ligand", "receptor")
    return sent.groupBy("stratum", "block", "first").cogroup(wants.groupBy("s", "b", "f")).applyInArrow(each, "stratum string, ligand string, receptor string, perm int, t double")


def permutation_test(counts: DataFrame, shares: DataFrame, cells: DataFrame, pairs: DataFrame, perms: int = 1000, seed: int = 0, weights: DataFrame | None = None) -> DataFrame:
    """community, batch, pooled, ligand, receptor, n_samples, stat, null_mean, null_sd, z, p, p_z, z_re, p_re, fwer of each testable pair.

    counts: cell, feature, count; shares: cell, community, share (pool.membership); cells: cell, batch, bin; pairs: ligand, receptor, each once, whose
    features both have counts; weights: feature, weight (missing: 1), whose product scales a pair's statistics. A pair whose observed covariance is
    exactly 0 or not a number cannot be tested and has no row. p counts ties half; fwer is the single-step minimum over the stratum's pairs. z_re compares
    a pair with the others of its stratum (upper median, scaled MAD); it is NaN where their spread is under a tenth of the median null_sd.
    Empty tables give no rows; null cells, batches or features drop out.
    """
    counts = counts.select("cell", "feature", F.col("count").cast("double").alias("count")).filter("feature IS NOT NULL AND count IS NOT NULL")
    names = counts.select(F.col("feature").cast("string").alias("feature")).distinct()
    pairs = pairs.select("ligand", "receptor").distinct()
    pairs = cut(pairs.join(names.withColumnRenamed("feature", "ligand"), "ligand", "left_semi").join(names.withColumnRenamed("feature", "receptor"), "receptor", "left_semi").select("ligand", "receptor"))
    genes = pairs.select(F.explode(F.array("ligand", "receptor")).alias("feature")).distinct()
    samples, values = pseudobulk(counts.join(genes, "feature", "left_semi"), shares.select("cell", "community", "share"), cells.filter("batch IS NOT NULL AND bin IS NOT NULL"))
    t = shuffled(samples, values, pairs, perms, seed)
    if weights is not None:
        one, two = (weights.select(F.col("feature").alias(c), F.col("weight").alias(f"w_{c}")) for c in ("ligand", "receptor"))
        t = t.join(one, "ligand", "left").join(two, "receptor", "left").na.fill(1.0, ["w_ligand", "w_receptor"])
        t = t.select(*PAIR, "perm", (F.col("t") * F.col("w_ligand") * F.col("w_receptor")).alias("t"))
    t = cut(t)
    stat = t.filter("perm = 0 AND NOT isnan(t) AND t <> 0").select(*PAIR, F.col("t").alias("stat"))
    null = t.filter("perm > 0").join(stat, PAIR)
    more, ties = F.count(F.when(F.col("t") > F.col("stat"), 1)), F.count(F.when(F.col("t") == F.col("stat"), 1))
    seen = null.groupBy(*PAIR).agg(F.first("stat").alias("stat"), F.avg("t").alias("null_mean"), F.stddev_samp("t").alias("null_sd"), more.alias("more"), ties.alias("ties"))
    seen = cut(seen.filter("null_sd > 0"))
    rank = F.row_number().over(W.partitionBy(*PAIR).orderBy(F.desc("t"), "perm"))
    least = null.join(seen.select(*PAIR), PAIR, "left_semi").select("stratum", "perm", rank.alias("rank")).groupBy("stratum", "perm").agg(F.min("rank").alias("rank"))
    minima = least.groupBy("stratum").agg(F.collect_list(F.col("rank") / perms).alias("minima"))  # one number a shuffle
    own = (F.col("more") + F.col("ties") + 1) / (perms + 1)
    out = seen.join(minima, "stratum").withColumn("fwer", (F.size(F.filter("minima", lambda m: m <= own)) + 1) / (perms + 1)).drop("minima")
    out = out.withColumn("z", (F.col("stat") - F.col("null_mean")) / F.col("null_sd")).withColumn("p", (F.col("more") + 0.5 * F.col("ties") + 0.5) / (perms + 1))
    by = W.partitionBy("stratum")

    def median(df, value, name):
        at = F.row_number().over(by.orderBy(value)) == F.floor(F.count(F.lit(1)).over(by) / 2) + 1
        return df.join(df.select("stratum", F.col(value).alias(name), at.alias("_at")).filter("_at").drop("_at"), "stratum")

    out = cut(median(median(out, "stat", "middle"), "null_sd", "noise").withColumn("far", F.abs(F.col("stat") - F.col("middle"))))
    scale = F.col("mad") * MAD
    z_re = F.when((scale >= 0.1 * F.col("noise")) & (scale > 0), (F.col("stat") - F.col("middle")) / scale).otherwise(float("nan"))
    out = median(out, "far", "mad").withColumn("z_re", z_re)
    about = samples.select("stratum", "community", "batch", "pooled", "n_samples").distinct()
    out = out.join(about, "stratum").select(F.col("community").cast("long").alias("community"), "batch", "pooled", "ligand", "receptor", "n_samples", "stat", "null_mean", "null_sd", "z", "p", "z_re", "fwer")

    def tails(batches):
        for b in batches:
            z, r = b["z"].to_numpy(zero_copy_only=False), b["z_re"].to_numpy(zero_copy_only=False)
            columns = {n: b[n] for n in b.schema.names}
            columns["p_z"] = pa.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z], pa.float64())
            columns["p_re"] = pa.array([math.erfc(abs(x) / math.sqrt(2)) for x in r], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return out.mapInArrow(tails, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", p_z double, p_re double")
