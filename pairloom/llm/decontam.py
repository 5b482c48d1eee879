"""Benchmark decontamination by the q-gram lemma.

An item of m bytes is found in a document where a part of the document is within k edits of it,
k = EDITS percent of m (bytes of UTF-8, A-Z lower-cased, white space read as blanks). k edits
destroy at most k * Q of the item's m - Q + 1 q-grams and shift diagonals by at most k in all. So
the shared q-grams are counted in overlapping diagonal bands, 2 (k + 1) wide and k + 1 apart; a band
with fewer than m - Q + 1 - k Q of them holds no occurrence, and the regions of the others are
verified by banded alignment (an exact occurrence in the region needs none).

The items are the query set, taken in blocks of at most BLOCK bytes of text (or one item); every
block's index is sent to the executors and all documents are scanned against it, whole and
without a shuffle. k is lowered for short items so that at least one q-gram must survive; items
under Q bytes (null and empty ones too) are not searched. Null and empty documents match nothing.
Repeated rows give repeated results, items of equal text are reported each. Extra columns are not
read by find(); clean() keeps them. Empty tables: no results, and every document is clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches, table

Q = 8
EDITS = 10
BLOCK = 2 << 20
_U = np.uint64
_BITS = 22
_MIX = _U(0x9E3779B97F4A7C15)
FOLD = bytes(32 if kernel.SEPARATORS[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTERS = kernel._LETTER[np.frombuffer(FOLD, np.uint8)]


def budget(m: int) -> int:
    return min(m * EDITS // 100, (m - Q) // Q)


def align(item: bytes, region: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of region nearest to item, if within most edits.

    The band is the whole region's diagonals: it was cut to one band. Of equally near parts the
    one that ends first, and of these the longest, is given.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    r = np.frombuffer(region, np.uint8)
    steps = np.arange(len(r) + 1)
    cost, start = np.zeros(len(r) + 1, np.int64), steps.copy()
    shift = len(r) + 1
    lag = max(0, len(r) - len(item)) + most  # diagonals beyond the region's are of no use
    for i, c in enumerate(item):
        a, z = max(0, i + 1 - most), min(len(r), i + 1 + lag)
        # cost and start in one number, so that the least cost wins, then the earliest start
        both = cost * shift + start
        new = both + shift
        new[1:] = np.minimum(new[1:], both[:-1] + np.where(r == c, 0, shift))
        new[:a], new[z + 1 :] = (most + 1 + len(item)) * shift, (most + 1 + len(item)) * shift
        new = np.minimum.accumulate(new - steps * shift) + steps * shift
        cost, start = new // shift, new % shift
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list[int | None], items: list[bytes]):
        self.ids, self.items = ids, items
        data = np.frombuffer(b"".join(items), np.uint8)
        sizes = np.array([len(x) for x in items], np.int64)
        ends = np.cumsum(sizes)
        grams = kernel.grams(data, Q, _LETTERS)
        who = np.repeat(np.arange(len(items)), sizes)[: len(grams)]
        place = np.arange(len(grams)) - (ends - sizes)[who]
        inside = place + Q <= sizes[who]
        order = np.argsort(grams[inside], kind="stable")
        self.grams, at, n = np.unique(grams[inside][order], return_index=True, return_counts=True)
        self.first, self.count = at, n
        self.item, self.place = who[inside][order].astype(np.int32), place[inside][order].astype(np.int32)
        self.k = np.array([budget(len(x)) for x in items], np.int64)
        self.need = sizes - Q + 1 - self.k * Q
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[((self.grams * _MIX) >> _U(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, band) with enough shared q-grams."""
        grams = kernel.grams(data, Q, _LETTERS)
        hit = np.flatnonzero(self.seen[((grams * _MIX) >> _U(64 - _BITS)).astype(np.int64)])
        if not len(hit) or not len(self.grams):
            return []
        k = np.minimum(np.searchsorted(self.grams, grams[hit]), len(self.grams) - 1)
        same = self.grams[k] == grams[hit]
        hit, k = hit[same], k[same]
        doc = np.searchsorted(at, hit, "right") - 1
        inside = hit + Q <= at[doc + 1]
        hit, k, doc = hit[inside], k[inside], doc[inside]
        n = self.count[k]
        rows = np.repeat(np.arange(len(hit)), n)
        entry = np.repeat(self.first[k], n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[entry].astype(np.int64)
        diagonal = (hit - at[doc])[rows] - self.place[entry]
        band = diagonal // (self.k[item] + 1)
        # band b holds diagonals from b (k + 1) to (b + 2) (k + 1): each q-gram is in two
        # a run of several texts is short: 24 bits hold its bands; a text alone in its run takes 44
        bits, zero = (24, 1 << 20) if len(at) > 2 else (44, 1 << 40)
        key = (doc[rows].astype(_U) << _U(44)) | (item.astype(_U) << _U(bits)) if len(at) > 2 else item.astype(_U) << _U(bits)
        shifted = (band + zero).astype(_U)
        keys, counts = np.unique(np.concatenate((key | shifted, key | (shifted - _U(1)))), return_counts=True)
        item = ((keys >> _U(bits)) & _U((1 << 20) - 1)).astype(np.int64)
        good = counts >= self.need[item]
        texts = (keys[good] >> _U(44)).tolist() if len(at) > 2 else [0] * int(good.sum())
        return list(zip(texts, item[good].tolist(), ((keys[good] & _U((1 << bits) - 1)).astype(np.int64) - zero).tolist(), strict=True))

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end): each item's best occurrence in each text, in code points."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        out = []
        for first, run in kernel.runs(texts):
            data, at = kernel.buffers(run)
            best.clear()
            folded: dict[int, bytes] = {}
            for doc, item, band in self.candidates(data, at):
                if doc not in folded:
                    folded = {doc: data[at[doc] : at[doc + 1]].tobytes().translate(FOLD)}
                k, m = int(self.k[item]), len(self.items[item])
                low = max(0, band * (k + 1) - k)
                high = min(len(folded[doc]), (band + 2) * (k + 1) + m + k)
                found = align(self.items[item], folded[doc][low:high], k)
                if found:
                    new = (found[0], found[1] + low, found[2] + low)
                    best[doc, item] = min(best.get((doc, item), new), new)
            for (doc, item), (edits, a, z) in sorted(best.items()):
                raw = data[at[doc] : at[doc + 1]].tobytes()
                chars = [len(raw[:x].decode("utf-8", "ignore")) for x in (a, z)]
                out.append((first + doc, item, edits, *chars))
        return out


def indexes(benchmark: DataFrame) -> list[Index]:
    """The items (item_id, text) as blocks' indexes: every block is read from the table by its numbers."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= Q)
    n = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-n // BLOCK))
    out = []
    for k in range(parts):
        got = rows.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        ids, items = got["item_id"].to_pylist(), [t.encode().translate(FOLD) for t in got["text"].to_pylist()]
        if items:
            out.append(Index(ids, items))
    return out


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end: each item's best occurrence in each row of docs that has one."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, edits int, start long, end long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark):
        out = out.unionByName(rows.mapInArrow(_finder(spark.sparkContext.broadcast(index)), schema))
    return out


def _finder(sent):
    def each(batches):
        for b in batches:
            index, found = sent.value, sent.value.matches(b.column("text"))
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                names=["doc_id", "item_id", "edits", "start", "end"],
            )

    return each


def _cleaner(sent, text: str):
    def each(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[f[0] for f in sent.value.matches(b.column(text).cast(pa.string()))]] = False
            yield b.filter(pa.array(keep))

    return each


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    names = docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    bounded_batches(docs.sparkSession)
    for index in indexes(benchmark):
        out = out.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(index), f"c{names.index('text')}"), out.schema)
    return out.toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
