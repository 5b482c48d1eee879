"""Quality: Naive Bayes support vectors over byte n-gram indicators.

Features are the distinct byte n-grams (n in SIZES) of the whole text, hashed into BUCKETS, and
indicators of how often a word follows itself (the word bigrams w w, too many to be listed one by
one). Each indicator is scaled by its log-count ratio r between the classes, texts are scaled to
unit length together with a constant (so that short texts lean on it), and a linear hinge-loss
model is fitted by dual coordinate descent. A fifth of the sample is kept
out of that fit to turn margins into probabilities (Platt's sigmoid through zero).

The fit uses at most about SAMPLE labelled training rows (fewer labelled rows: all of them), chosen
by a hash of doc_id, so it is the same at every size and partitioning. Model and sample are
bounded: two arrays of BUCKETS numbers are sent to the executors. Scoring is one pass over
documents without a shuffle. labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no features and score by the bias alone. With labels of one class only,
every text scores that class (0 or 1); with no labels, 1. Repeated rows stay repeated, extra
columns are not read, a doc_id with several labels takes the largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches, remainder, table

SIZES = (3, 4)
BITS = 18
BUCKETS = 1 << BITS
#: A word that follows itself: so often, or in such a share of the words.
OFTEN, SHARE = (1, 2, 4, 8, 16), (0.02, 0.05, 0.1, 0.2, 0.4)
WIDTH = BUCKETS + len(OFTEN) + len(SHARE)
#: The constant's square beside the indicators' scaled squares.
CONSTANT = 100.0
SAMPLE = 6000
COST = 3.0
EPOCHS = 12


def features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct indicators of each text."""
    out: list[np.ndarray] = []
    seen = np.zeros(BUCKETS, np.int64)
    for _, run in kernel.runs(texts):
        data, at = kernel.buffers(run)
        hashed = [((kernel.grams(data, n) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32) for n in SIZES]
        bounds, words = kernel.words(run)
        same = np.concatenate(([0], np.cumsum(words[1:] == words[:-1]))) if len(words) else np.zeros(1, np.int64)
        for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            first, last = int(bounds[i]), int(bounds[i + 1])
            n_same = int(same[last - 1] - same[first]) if last - first > 1 else 0
            marks = [*(n_same >= k for k in OFTEN), *(n_same > s * (last - first) for s in SHARE)] if n_same else []
            own = np.concatenate([h[a : max(a, z - n + 1)] for n, h in zip(SIZES, hashed, strict=True)])
            place = np.arange(len(own))
            seen[own] = place
            own = own[seen[own] == place]
            out.append(np.concatenate((own, BUCKETS + np.flatnonzero(marks))).astype(np.int32) if n_same else own)
    return out


class Model:
    """score(text) = sigmoid(slope * (bias + sum of weight) / sqrt(CONSTANT + sum of square))."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, slope: float):
        self.weight, self.square, self.bias, self.slope = weight, square, bias, slope

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([(self.bias + self.weight[u].sum(dtype=np.float64)) / np.sqrt(CONSTANT + self.square[u].sum(dtype=np.float64)) for u in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows), -700, 700)))


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log-count ratio of every bucket, each class's counts smoothed by one and normalised."""
    p, q = np.ones(WIDTH), np.ones(WIDTH)
    for u, g in zip(rows, good, strict=True):
        (p if g else q)[u] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], sign: np.ndarray, r: np.ndarray, costs: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss weights (over scaled indicators) and the constant's, by dual coordinate descent."""
    scaled = []
    for u in rows:
        v = r[u]
        length = np.sqrt(CONSTANT + v @ v)
        scaled.append((v / length, np.sqrt(CONSTANT) / length))
    w, constant, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            u, (v, one), y = rows[i], scaled[i], sign[i]
            new = min(max(alpha[i] + 1 - y * (w[u] @ v + constant * one), 0.0), costs[i])  # every row has length one
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[u] += step * v
                constant += step * one
                alpha[i] = new
    return w, constant


def fit_rows(texts: pa.Array, good: np.ndarray) -> Model:
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 1.0 if not len(good) or good.all() else -1.0, 1e4)
    rows = features(texts)
    kept_out = np.arange(len(rows)) % 5 == 4
    if good[kept_out].all() or not good[kept_out].any() or good[~kept_out].all() or not good[~kept_out].any():
        kept_out[:] = False
    own = [u for u, k in zip(rows, kept_out, strict=True) if not k]
    y = good[~kept_out]
    r = ratios(own, y)
    share = y.mean()
    costs = COST * np.where(y, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    w, constant = descend(own, np.where(y, 1.0, -1.0), r, costs)
    model = Model((w * r).astype(np.float32), (r * r).astype(np.float32), constant * np.sqrt(CONSTANT), 2.0)
    if kept_out.any():
        margin, want = model.margins([u for u, k in zip(rows, kept_out, strict=True) if k]), good[kept_out].astype(float)
        slopes = np.linspace(0.5, 20, 40)
        model.slope = float(slopes[np.argmin([np.logaddexp(0, -s * margin * (2 * want - 1)).sum() for s in slopes])])
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out_of: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows whose remainder is not held_out, or about sample of them."""
    spark = docs.sparkSession
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(remainder(F.col("doc_id"), held_out_of) != held_out)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    n = known.count()
    if n > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(sample / n * (1 << 32)))
    chosen = known.toArrow()  # about sample rows of two integers
    small = F.broadcast(spark.createDataFrame(chosen)) if chosen.num_rows else known
    got = docs.select("doc_id", "text").filter("text IS NOT NULL").join(small, "doc_id").select("doc_id", "text", "quality")
    got = got.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "quality"]).toArrow().sort_by([("h", "ascending"), ("quality", "ascending")])
    return fit_rows(got["text"].combine_chunks(), got["quality"].to_numpy() == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(sent.value.scores(features(b.column("text"))), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
