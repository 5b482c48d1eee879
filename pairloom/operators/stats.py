"""Order statistics, multiplicity, clustered errors: grouped and windowed, never one array per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def ranked_element(df: DataFrame, by: list[str], value: str, at: Column, out: str) -> DataFrame:
    """by, out: the element of rank `at` (from 0, an expression of the group's count n), NaN and null left out."""
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    keys = by or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return ranked.filter(F.col("r") == at).select(*by, F.col(value).alias(out))


def upper_median_by(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The element at n / 2."""
    return ranked_element(df, by, value, F.floor(F.col("n") / 2), out)


def quantile_by(df: DataFrame, by: list[str], value: str, q: float, out: str) -> DataFrame:
    """The element at round(q (n - 1))."""
    return ranked_element(df, by, value, F.floor((F.col("n") - 1) * q + 0.5), out)


def _slice(p: Column) -> Column:
    """A number that grows with p: 64 slices of [0, 1], the first of them by powers of two, as small p crowd there."""
    fine = F.coalesce(F.greatest(F.floor(F.log2(p)) + 5, F.lit(-1100)), F.lit(-1101))  # log2 of 0 or less is null
    return F.when(p < 1 / 64, fine).otherwise(F.floor(F.least(p, F.lit(1e6)) * 64)).cast("int")


def bh(df: DataFrame, by: list[str], p: str, out: str) -> DataFrame:
    """Benjamini-Hochberg q within families; a NaN or null p is no test and gets NaN.

    q = the running minimum, from the largest p down, of p m / rank. Of equal p the last has the largest rank: all get
    its value, so the windows run over distinct p. They run within slices of p; what lies before and after a slice
    comes from a table of slices.
    """
    tested = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    keys = [f"_b{i}" for i in range(len(by))]
    distinct = tested.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", _slice(F.col("_p")))
    distinct = cut(distinct)
    family, within = W.partitionBy(*keys), W.partitionBy(*keys, "_k")

    def joined(one: DataFrame, slices: DataFrame) -> DataFrame:
        slices = slices.select(*[F.col(c).alias(f"_r{c}") for c in [*keys, "_k"]], *[c for c in slices.columns if c not in [*keys, "_k"]])
        on = F.col("_k") == F.col("_r_k")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_r{k}"))
        return one.join(slices, on).drop(*[f"_r{c}" for c in [*keys, "_k"]])

    sizes = distinct.groupBy(*keys, "_k").agg(F.sum("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(family.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_k", before.alias("_before"), F.sum("_size").over(family).alias("_m"))
    rank = F.col("_before") + F.sum("_n").over(within.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    scaled = joined(distinct, sizes).withColumn("_s", F.col("_p") * F.col("_m") / rank)
    later = F.min("_low").over(family.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, -1))
    lows = scaled.groupBy(*keys, "_k").agg(F.min("_s").alias("_low")).select(*keys, "_k", later.alias("_later"))
    least = F.min("_s").over(within.orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0))
    q = joined(scaled, lows).select(*keys, "_p", F.least(least, F.col("_later"), F.lit(1.0)).alias("_q"))
    on = F.col(p) == F.col("_p")
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return df.join(q, on, "left").withColumn(out, F.coalesce("_q", F.lit(float("nan")))).drop(*keys, "_p", "_q")


def simes(df: DataFrame, by: list[str], p: str, out: str) -> DataFrame:
    """by, out: the least of p m / rank in each group, without NaN; NaN for groups without a test."""
    tested = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    s = tested.withColumn("_s", F.col(p) * F.count(F.lit(1)).over(W.partitionBy(*by)) / F.row_number().over(W.partitionBy(*by).orderBy(p)))
    got = s.groupBy(*by).agg(F.least(F.min("_s"), F.lit(1.0)).alias(out))
    return df.select(*by).distinct().join(got, by, "left").withColumn(out, F.coalesce(out, F.lit(float("nan"))))


#: Up to so many tests the harmonic number is summed; above, its expansion is exact to the last bits.
SUMMED = 10_000


def by_adjust(df: DataFrame, by: list[str], p: str, out: str) -> DataFrame:
    """Benjamini-Yekutieli: BH times the harmonic number of the family's tests, which is formed once a family."""
    n = F.greatest(F.count(F.when(~F.isnan(p), 1)), F.lit(1))
    summed = F.aggregate(F.sequence(F.lit(1), F.least("_n", F.lit(SUMMED)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = F.col("_n").cast("double")
    expanded = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    families = df.groupBy(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(by)]).agg(n.alias("_n"))
    families = families.select(*[f"_f{i}" for i in range(len(by))], F.when(F.col("_n") <= SUMMED, summed).otherwise(expanded).alias("_h"))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_f{i}"))
    adjusted = bh(df, by, p, out).join(families, on)
    return adjusted.withColumn(out, F.when(F.isnan(out), F.col(out)).otherwise(F.least(F.col(out) * F.col("_h"), F.lit(1.0)))).drop("_h", *[f"_f{i}" for i in range(len(by))])


def clustered(df: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    """by, sd, effective: the SD of a sum over the C clusters whose own sum S is not zero, and how many of them it rests on.

    sqrt(sum S^2 C / (C - 1)), unscaled below two clusters; 3 (sum S^2)^2 / sum S^4 within [2, C], NaN below two.
    """
    s = df.groupBy(*by, cluster).agg(F.sum(value).alias("s"))
    c, s2, s4 = F.count(F.when(F.col("s") != 0, 1)), F.sum(F.col("s") * F.col("s")), F.sum(F.pow("s", F.lit(4.0)))
    sd = F.when(c > 1, F.sqrt(s2 * c / (c - 1))).otherwise(F.sqrt(s2))
    rests = F.when((s4 > 0) & (s4 < float("inf")), F.greatest(F.lit(2.0), F.least(c.cast("double"), 3 * s2 * s2 / s4))).otherwise(c.cast("double"))
    return s.groupBy(*by).agg(sd.alias("sd"), F.when(c > 1, rests).otherwise(F.lit(float("nan"))).alias("effective"))


def jackknife_se(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, se: sqrt((G - 1) / G sum (v - mean)^2) of leave-one-out values; NaN below two."""
    n = F.count(F.lit(1))
    ss = F.var_pop(value) * n
    return df.groupBy(*by).agg(F.when(n > 1, F.sqrt((n - 1) / n * ss)).otherwise(F.lit(float("nan"))).alias("se"))


def midranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing the mean of their places."""
    rank = F.rank().over(W.partitionBy(*by).orderBy(value))
    return df.withColumn(out, rank + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2.0)


def restandardise(df: DataFrame, by: list[str], value: str, out: str, floor: float = 0.0) -> DataFrame:
    """(x - median) / max(1.4826 MAD, floor), both upper medians."""
    med = upper_median_by(df, by, value, "_m")
    centred = df.join(med, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = upper_median_by(centred, by, "_d", "_mad")
    return centred.join(mad, by).withColumn(out, (F.col(value) - F.col("_m")) / F.greatest(F.col("_mad") * 1.4826, F.lit(floor))).drop("_m", "_d", "_mad")


def mad_outliers(df: DataFrame, by: list[str], value: str, times: float) -> DataFrame:
    """Rows within `times` scaled MADs of their group's median."""
    z = restandardise(df, by, value, "_z", 1e-9)
    return z.filter(F.abs("_z") <= times).drop("_z")


def weighted_cov(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """by, cov: sum w (x - mx)(y - my) / sum w, in one pass; an exact 0 or no weight is NaN."""
    sw, sx, sy, sxy = (F.sum(e) for e in (F.col(w), F.col(w) * F.col(x), F.col(w) * F.col(y), F.col(w) * F.col(x) * F.col(y)))
    cov = sxy / sw - sx / sw * (sy / sw)
    return df.groupBy(*by).agg(F.when((sw > 0) & (cov != 0), cov).otherwise(F.lit(float("nan"))).alias("cov"))


def eta_squared(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """by, eta2: between-group over total sum of squares; 0 if nothing varies."""
    g = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    total = q - s * s / n
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    return g.groupBy(*by).agg(F.when(total > 1e-12, between / total).otherwise(0.0).alias("eta2"))


#: Bins of one pass of order_statistics, and values of a bin that the driver sorts.
BINS, SORTED = 4096, 200_000


def order_statistics(values: DataFrame, ranks: list[int]) -> list[float]:
    """The elements of the given ranks (from 0) of the one column v, without sorting the table: passes of histograms
    close in on the ranks until a bin holds one value or few."""
    out: dict[int, float] = {}

    def within(low: float, high: float, first: int, own: list[int]) -> None:
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        at = F.least(F.floor((F.col("v") - low) / ((high - low) / BINS)), F.lit(BINS - 1)).cast("int")
        bins = sorted(tuple(r) for r in inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect())
        few = []
        for _, n, a, z in bins:
            mine = [r for r in own if first <= r < first + n]
            if mine and a == z:
                out.update(dict.fromkeys(mine, a))
            elif mine and n <= SORTED // 16:
                few.append((a, z, first, mine))
            elif mine:
                within(a, z, first, mine)
            first += n
        for i in range(0, len(few), 16):
            some = few[i : i + 16]
            wanted = F.lit(False)
            for a, z, _, _ in some:
                wanted = wanted | ((F.col("v") >= a) & (F.col("v") <= z))
            got = sorted(r[0] for r in inside.filter(wanted).select("v").collect())  # SORTED values at most
            for a, z, start, mine in some:
                held = [x for x in got if a <= x <= z]
                out.update({r: held[r - start] for r in mine})

    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if ranks and (min(ranks) < 0 or max(ranks) >= n):
        raise ValueError("no such rank")
    if ranks and low == high:
        return [low] * len(ranks)
    if ranks:
        within(low, high, 0, sorted(set(ranks)))
    return [out[r] for r in ranks]


def quantiles(values: DataFrame, shares: tuple[float, ...]) -> list[float]:
    """Quantiles of the column v, interpolated between neighbours (type 7); NaN and null left out."""
    values = values.filter(F.col("v").isNotNull() & ~F.isnan("v")).select("v")
    n = values.count()
    if not n:
        return [float("nan")] * len(shares)
    places = [(n - 1) * q for q in shares]
    ranks = [r for x in places for r in (int(x), min(int(x) + 1, n - 1))]
    got = order_statistics(values, ranks)
    return [got[2 * i] + (x - int(x)) * (got[2 * i + 1] - got[2 * i]) for i, x in enumerate(places)]
