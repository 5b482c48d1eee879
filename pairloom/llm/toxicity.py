"""Toxicity: class-conditional Kneser-Ney models over the pieces of words.

A word is two pieces: its stem (the first STEM code points) and the whole word. Each class has its own
stem distribution; below it stands one backoff that both classes share,

    P_class(stem) = (c - d(c)) / C + (sum of d) / C * N1+(stem) / N1+(all)

with c the stem's count in the class's texts, d(c) = 1, 2, 3 for counts of 1, 2, 3 and more (so
that expressions seen once or twice rest on the shared counts), and N1+(stem) the number of
distinct words with that stem in either class (the continuation count). Given its stem, a word is
drawn from shared counts, which cancel in the ratio. The log-likelihood ratio of a text is summed
over words above MARGIN nats (smaller ratios are topic, not toxicity) and divided by the square
root of the number of words.

The counts come from every labelled training row; they and the tables
made from them grow with the input. (Of texts that are equal and of one class, one doc_id counts.) The decision threshold is fitted by FOLDS-fold cross-scoring of
all training rows. What the executors get is the list of stems with a ratio above MARGIN, in
blocks of at most BLOCK stems: beyond one block the texts are scored against one block after
another. With no training rows of one class no text is toxic (score 0).

Null and empty texts have no words: evidence 0. Repeated rows stay repeated. Extra columns are
not read. A row whose doc_id has several labels counts as toxic if one of them is 1; null labels
are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import Store, bounded_batches, remainder, table

STEM = 5
MARGIN = 2.0
BLOCK = 1 << 20
#: So many training documents (24 bytes each) are broadcast at most.
SENT = 1 << 20
#: Bins of the histogram of evidence from which the threshold is fitted, each 0.02 wide.
BINS, WIDTH = 1000, 0.02


FOLDS = 5


def _count(batches):
    """Stem, word, class, fold -> tokens, summed within each run of rows."""
    for b in batches:
        side = np.asarray(b.column("toxic").to_numpy(zero_copy_only=False), np.int64) * FOLDS + b.column("fold").to_numpy(zero_copy_only=False)
        for first, run in kernel.runs(b.column("text")):
            bounds, words, stems = kernel.words(run, STEM)
            own = np.repeat(side[first : first + len(run)], np.diff(bounds))
            for k in range(2 * FOLDS):
                pick = own == k
                if pick.any():
                    w, at, n = np.unique(words[pick], return_index=True, return_counts=True)
                    s = stems[pick][at]
                    yield pa.record_batch([pa.array(s.view(np.int64)), pa.array(w.view(np.int64)), pa.array(np.full(len(w), k, np.int32)), pa.array(n.astype(np.int64))], names=["stem", "word", "side", "n"])


class Marked:
    """Stems with their ratio above MARGIN, sorted, to be looked up."""

    def __init__(self, stems: np.ndarray, over: np.ndarray):
        order = np.argsort(stems)
        self.stems, self.over = stems[order], over[order].astype(np.float32)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.stems & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __reduce__(self):
        return Marked, (self.stems, self.over)

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the sum of ratios over MARGIN, and the number of words."""
        out, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for first, run in kernel.runs(texts):
            bounds, _, stems = kernel.words(run, STEM)
            hit = np.flatnonzero(self.seen[(stems & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(hit) and len(self.stems):
                at = np.minimum(np.searchsorted(self.stems, stems[hit]), len(self.stems) - 1)
                same = self.stems[at] == stems[hit]
                doc = np.searchsorted(bounds, hit[same], "right") - 1
                out[first : first + len(run)] = np.bincount(doc, weights=self.over[at[same]], minlength=len(run))
            n[first : first + len(run)] = np.diff(bounds)
        return out, n


class Model:
    """Blocks of marked stems, the threshold on evidence, and the slope of the score."""

    def __init__(self, blocks: list[Marked], threshold: float):
        self.blocks, self.threshold = blocks, threshold


def ratios(stems: DataFrame, toxic: str, plain: str) -> DataFrame:
    """stem, over: the stems whose log-likelihood ratio is above MARGIN. stems: stem, kinds and the two classes' counts."""

    def taken(c):
        return F.least(F.col(c), F.lit(3))

    total = stems.agg(*[F.sum(c).alias(f"C_{c}") for c in (toxic, plain)], *[F.sum(taken(c)).alias(f"D_{c}") for c in (toxic, plain)], F.sum("kinds").alias("K")).first()
    if not total[f"C_{toxic}"] or not total[f"C_{plain}"]:
        return stems.select("stem", F.lit(0.0).alias("over")).limit(0)

    def p(c):
        return (F.col(c) - taken(c) + total[f"D_{c}"] * F.col("kinds") / total["K"]) / total[f"C_{c}"]

    return stems.select("stem", (F.log(p(toxic)) - F.log(p(plain)) - MARGIN).alias("over")).filter("over > 0")


def _blocks(marked: DataFrame) -> list[Marked]:
    """In blocks by the stem's hash, so that each has about BLOCK stems at most."""
    n = marked.count()
    parts = max(1, -(-n // (BLOCK * 9 // 10)))
    out = []
    for k in range(parts):
        got = marked.filter(F.pmod(F.hash("stem"), F.lit(parts)) == k).toArrow()
        out.append(Marked(got["stem"].to_numpy().astype(np.int64).view(np.uint64), got["over"].to_numpy()))
    return out


def _evidence(docs: DataFrame, blocks: list[Marked], keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, and evidence; one pass over the texts for each block. keep may hold the text's own column."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*keep, *([] if text in keep else [text]), F.lit(0.0).alias("evidence"))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        sent = spark.sparkContext.broadcast(block)

        def each(batches, sent=sent, last=last):
            for b in batches:
                got, n = sent.value.sums(b.column(text).cast(pa.string()))
                total = b.column("evidence").to_numpy(zero_copy_only=False) + got
                if last:
                    total = total / np.sqrt(np.maximum(n, 1))
                names = keep if last else [x for x in b.schema.names if x != "evidence"]
                yield pa.record_batch([*[b.column(x) for x in names], pa.array(total)], names=[*names, "evidence"])

        fields = [f for f in docs.schema if f.name in keep or (f.name == text and not last)]
        docs = docs.mapInArrow(each, T.StructType([*fields, T.StructField("evidence", T.DoubleType())]))
    return docs


def training_rows(store: Store, docs: DataFrame, labels: DataFrame, held_out_of: int) -> DataFrame:
    """text, toxic, fold of the rows to learn from; of documents with equal text and class one stays.

    Which documents those are is found from ids and hashes alone. Up to SENT of them are broadcast
    to the texts (the count is checked); more are joined by shuffling both sides.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).filter("text IS NOT NULL").filter(remainder(F.col("doc_id"), held_out_of) != 0)
    chosen = store.write(texts.select("doc_id", "h").join(known, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")))
    met = texts.join(F.broadcast(chosen) if chosen.count() <= SENT else chosen, ["doc_id", "h"])
    rows = store.write(met.select("text", "toxic", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")))
    store.drop(chosen)
    store.release()
    return rows


def fit(docs: DataFrame, labels: DataFrame, held_out_of: int = 5) -> Model:
    bounded_batches(docs.sparkSession)
    store = Store(docs.sparkSession)
    rows = training_rows(store, docs, labels, held_out_of)
    words = rows.mapInArrow(_count, "stem long, word long, side int, n long").groupBy("stem", "word").agg(*[F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS)])
    stems = store.write(words.groupBy("stem").agg(F.count(F.lit(1)).alias("kinds"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(2 * FOLDS)]))
    def sides(without: int | None = None) -> DataFrame:
        def total(c):
            return sum((F.col(f"n{c * FOLDS + k}") for k in range(FOLDS) if k != without), F.lit(0))

        return stems.select("stem", "kinds", total(0).alias("plain"), total(1).alias("toxic"))

    blocks = _blocks(ratios(sides(), "toxic", "plain"))
    counts = np.zeros((2, BINS), np.int64)
    for fold in range(FOLDS):  # each fold by the counts of the others
        other = _blocks(ratios(sides(fold), "toxic", "plain"))
        got = _evidence(rows.filter(F.col("fold") == fold), other, ["toxic"])
        bins = got.groupBy("toxic", F.least(F.floor(F.col("evidence") / WIDTH), F.lit(BINS - 1)).alias("bin")).count()
        for toxic, bin_, n in bins.collect():
            counts[int(toxic == 1), int(bin_)] += n
    store.drop(rows, stems)
    return Model(blocks, threshold(counts))


def threshold(counts: np.ndarray) -> float:
    """The middle of the thresholds with the fewest errors, from the two classes' histograms."""
    missed = np.concatenate(([0], np.cumsum(counts[1])))
    wrong = counts[0].sum() - np.concatenate(([0], np.cumsum(counts[0])))
    errors = (missed + wrong)[1:-1]
    best = np.flatnonzero(errors == errors.min())
    if not counts.sum() or errors.min() == 0 and not counts[1].sum():
        return 0.45
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    # an open gap up to the last bin says little: stay near the plain texts' side
    return float((run[0] + 1 + min(run[-1] + 1, run[0] + 51)) / 2 * WIDTH)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep, and score and predicted; docs has a text column."""
    out = _evidence(docs, model.blocks, keep)
    s = 1 / (1 + F.exp(-(F.col("evidence") - model.threshold) * 4 / max(model.threshold, 0.1)))
    return out.select(*keep, s.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, ["doc_id"]).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with all their columns.

    The score's own columns have names that no column of docs has, so clashing names don't matter.
    """
    model = fit(docs, labels)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = [f"c{i}" for i in range(len(names))]
    scored = _evidence(plain, model.blocks, kept, f"c{names.index('text')}")
    return scored.filter(F.col("evidence") < model.threshold).select(*kept).toDF(*names)


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
