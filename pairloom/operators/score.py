"""Comparing partitions and scores: contingency, agreement indices, ranking measures, matchings, paired tests."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import choose2, x_ln_x

#: Communities collected to the driver for a matching, at most.
MOST = 5000


def contingency(pairs: DataFrame) -> DataFrame:
    """a, b, n, fraction_of_a, fraction_of_b, jaccard over items labelled by both. pairs: a, b."""
    n = pairs.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    na, nb = F.sum("n").over(W.partitionBy("a")), F.sum("n").over(W.partitionBy("b"))
    return n.select("a", "b", "n", (F.col("n") / na).alias("fraction_of_a"), (F.col("n") / nb).alias("fraction_of_b"), (F.col("n") / (na + nb - F.col("n"))).alias("jaccard"))


def _margins(pairs: DataFrame) -> DataFrame:
    """One row: n, and sums over cells, rows and columns of choose2 and of x ln x."""
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = n.agg(F.sum("n").alias("n"), F.sum(choose2(F.col("n"))).alias("c"), F.sum(x_ln_x(F.col("n"))).alias("h"))
    rows = n.groupBy("a").agg(F.sum("n").alias("s")).agg(F.sum(choose2(F.col("s"))).alias("ca"), F.sum(x_ln_x(F.col("s"))).alias("ha"), F.count(F.lit(1)).alias("ka"))
    columns = n.groupBy("b").agg(F.sum("n").alias("s")).agg(F.sum(choose2(F.col("s"))).alias("cb"), F.sum(x_ln_x(F.col("s"))).alias("hb"), F.count(F.lit(1)).alias("kb"))
    return cells.join(rows).join(columns)  # three tables of one row


def ari(pairs: DataFrame) -> DataFrame:
    """Adjusted Rand index (Hubert and Arabie); 1 where the expected and the largest index are equal."""
    m = _margins(pairs)
    expected = F.col("ca") * F.col("cb") / choose2(F.col("n"))
    largest = (F.col("ca") + F.col("cb")) / 2
    return m.select(F.when(F.abs(largest - expected) < 1e-12, 1.0).otherwise((F.col("c") - expected) / (largest - expected)).alias("ari"))


def nmi(pairs: DataFrame) -> DataFrame:
    """Mutual information over the mean entropy, within [0, 1]; 1 where both entropies are 0."""
    m = _margins(pairs)
    n = F.col("n")
    ln = F.log(n)
    ha, hb = ln - F.col("ha") / n, ln - F.col("hb") / n
    mi = ln + (F.col("h") - F.col("ha") - F.col("hb")) / n
    return m.select(F.when(ha + hb < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * mi / (ha + hb)))).alias("nmi"))


def ami_of(table: np.ndarray) -> float:
    """Adjusted mutual information of a contingency table, with the exact expected value; 1 for equal trivial partitions."""
    n = int(table.sum())
    a, b = table.sum(1).astype(int), table.sum(0).astype(int)
    a, b = a[a > 0], b[b > 0]
    if len(a) == len(b) == 1 or len(a) == len(b) == n:
        return 1.0
    lg = [math.lgamma(i + 1) for i in range(n + 1)]

    def entropy(x):
        return -sum(v / n * math.log(v / n) for v in x)

    full = table[table.sum(1) > 0][:, table.sum(0) > 0]
    mi = sum(full[i, j] / n * math.log(n * full[i, j] / (a[i] * b[j])) for i, j in zip(*np.nonzero(full), strict=True))
    expected = 0.0
    for x in a.tolist():
        for y in b.tolist():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                expected += k / n * math.log(n * k / (x * y)) * math.exp(lg[x] + lg[y] + lg[n - x] + lg[n - y] - lg[n] - lg[k] - lg[x - k] - lg[y - k] - lg[n - x - y + k])
    mean = (entropy(a) + entropy(b)) / 2
    return (mi - expected) / (mean - expected)


def matrix(pairs: DataFrame) -> tuple[list, list, np.ndarray]:
    """Row labels, column labels and counts, of at most MOST distinct pairs of labels."""
    rows = pairs.groupBy("a", "b").count().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} pairs of communities")
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    out = np.zeros((len(a), len(b)))
    for r in rows:
        out[a.index(r["a"]), b.index(r["b"])] = r["count"]
    return a, b, out


def ami(pairs: DataFrame) -> DataFrame:
    return pairs.sparkSession.createDataFrame([(float(ami_of(matrix(pairs)[2])),)], "ami double")


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the largest total gain: shortest augmenting paths on the negated gain."""
    if gain.shape[0] > gain.shape[1]:
        return sorted((i, j) for j, i in assignment(gain.T))
    n, m = gain.shape
    cost = gain.max(initial=0.0) - gain
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, back, done = cost[i] - u[i] - v, np.full(m, -1), np.zeros(m, bool)
        while True:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if match[j] < 0:
                break
            step = dist[j] + cost[match[j]] - u[match[j]] - v
            better = ~done & (step < dist)
            dist, back = np.where(better, step, dist), np.where(better, j, back)
        least = dist[j]
        used = np.flatnonzero(done)
        for k in used:
            if match[k] >= 0:
                u[match[k]] += least - dist[k]
            v[k] -= least - dist[k]
        u[i] += least
        while back[j] >= 0:
            match[j] = match[back[j]]
            j = back[j]
        match[j] = i
    return sorted((int(i), int(j)) for j, i in enumerate(match) if i >= 0)


def match(pairs: DataFrame) -> DataFrame:
    """a, b, jaccard: the one-to-one matching of communities with the largest total Jaccard index."""
    a, b, n = matrix(pairs)
    union = n.sum(1)[:, None] + n.sum(0)[None, :] - n
    j = n / union
    rows = [(a[x], b[y], float(j[x, y])) for x, y in assignment(j)]
    kinds = dict(pairs.dtypes)
    return pairs.sparkSession.createDataFrame(rows, f"a {kinds['a']}, b {kinds['b']}, jaccard double")


def fates(table: DataFrame, tau: float) -> DataFrame:
    """a, partners, fate of each community of the first partition, by overlaps of at least tau.

    kept: one partner that has no other; merged: one partner, shared; split: several; vanished: none.
    """
    strong = table.withColumn("out", F.col("fraction_of_a") >= tau).withColumn("in", F.col("fraction_of_b") >= tau).filter("out OR in")
    per_b = strong.withColumn("others", F.count(F.lit(1)).over(W.partitionBy("b")))
    got = per_b.groupBy("a").agg(F.count(F.lit(1)).alias("partners"), F.max("others").alias("others"))
    out = table.select("a").distinct().join(got, "a", "left").select("a", F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("others", F.lit(0)).alias("others"))
    fate = F.when(F.col("partners") == 0, "vanished").when(F.col("partners") > 1, "split").when(F.col("others") > 1, "merged").otherwise("kept")
    return out.select("a", "partners", fate.alias("fate"))


def auroc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, auroc: Mann-Whitney with midranks; NaN with one class. scored: truth (0/1), score.

    Counts by distinct score and running sums over these, so a group of equal scores is one row.
    """
    t = scored.groupBy(*by, "score").agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
    w = W.partitionBy(*by).orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    p, n = F.sum("pos"), F.sum("neg")
    u = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return t.groupBy(*by).agg(F.when((p > 0) & (n > 0), u / (p * n)).otherwise(F.lit(float("nan"))).alias("auroc"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, ap: the mean precision at each positive, equal scores being one threshold; NaN without positives."""
    t = scored.groupBy(*by, "score").agg(F.sum("truth").alias("pos"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("precision", F.sum("pos").over(w) / F.sum("n").over(w))
    p = F.sum("pos")
    return t.groupBy(*by).agg(F.when(p > 0, F.sum(F.col("pos") * F.col("precision")) / p).otherwise(F.lit(float("nan"))).alias("ap"))


def conditional_entropy_ratio(rows: DataFrame) -> DataFrame:
    """invariance = H(donor | label, domain) / H(donor | domain), pooled over domains; NaN if donors never mix."""
    joint = rows.groupBy("domain", "label", "donor").agg(F.count(F.lit(1)).cast("double").alias("n"))
    label = joint.groupBy("domain", "label").agg((x_ln_x(F.sum("n")) - F.sum(x_ln_x(F.col("n")))).alias("h"))
    donor = joint.groupBy("domain", "donor").agg(F.sum("n").alias("n")).groupBy("domain").agg((x_ln_x(F.sum("n")) - F.sum(x_ln_x(F.col("n")))).alias("h"))
    one = label.agg(F.sum("h").alias("within")).join(donor.agg(F.sum("h").alias("all")))
    return one.select(F.when(F.col("all") > 0, F.col("within") / F.col("all")).otherwise(F.lit(float("nan"))).alias("invariance"))


def patches(rows: DataFrame) -> DataFrame:
    """domain, label, f1: the label of largest F1 within the domain's owner; ties to the larger overlap, then the lesser label."""
    both = rows.filter("domain IS NOT NULL").groupBy("owner", "domain", "label").agg(F.count(F.lit(1)).alias("n"))
    labels = rows.groupBy("owner", "label").agg(F.count(F.lit(1)).alias("nl"))
    size = rows.filter("domain IS NOT NULL").groupBy("owner", "domain").agg(F.count(F.lit(1)).alias("nd"))
    f1 = both.join(labels, ["owner", "label"]).join(size, ["owner", "domain"]).withColumn("f1", 2.0 * F.col("n") / (F.col("nl") + F.col("nd")))
    r = F.row_number().over(W.partitionBy("owner", "domain").orderBy(F.desc("f1"), F.desc("n"), "label"))
    return f1.withColumn("r", r).filter("r = 1").select("owner", "domain", "label", "f1")


def paired(rows: DataFrame) -> DataFrame:
    """donor, delta, count: sum(a - b) / sum(count); a donor whose counts differ by over a half is refused."""
    bad = rows.filter(F.abs(F.col("count_a") - F.col("count_b")) > 0.5)
    if not bad.isEmpty():
        raise ValueError("the two sides score different counts")
    return rows.groupBy("donor").agg((F.sum(F.col("llik_a") - F.col("llik_b")) / F.sum("count_a")).alias("delta"), F.sum("count_a").alias("count"))


def sign_test(deltas: list[float]) -> float:
    """Two-sided exact sign test without zeros; 1 if none is left."""
    d = [x for x in deltas if x]
    if not d:
        return 1.0
    k = min(sum(x > 0 for x in d), sum(x < 0 for x in d))
    return min(1.0, 2 * sum(math.comb(len(d), i) for i in range(k + 1)) / 2 ** len(d))


def wilcoxon(deltas: list[float]) -> float:
    """Two-sided exact signed-rank test, midranks for ties, by counting subsets of doubled ranks; NaN below two differences."""
    d = sorted((x for x in deltas if x), key=abs)
    if len(d) < 2:
        return float("nan")
    ranks: list[int] = []  # doubled midranks
    for _, run in itertools.groupby(d, key=abs):
        n = len(list(run))
        ranks += [2 * len(ranks) + n + 1] * n
    ways = {0: 1}
    for r in ranks:
        new = dict(ways)
        for s, n in ways.items():
            new[s + r] = new.get(s + r, 0) + n
        ways = new
    plus, total = sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(ranks)
    least = min(plus, total - plus)
    return min(1.0, 2 * sum(n for s, n in ways.items() if s <= least) / 2 ** len(d))
