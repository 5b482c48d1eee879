"""Mixing sources to target weights by the cube method.

Each source gets a target of words; a document of it is taken target / source size times in
expectation: floor of that for certain, and the fraction as an inclusion probability. The flight
phase moves three fractional units at a time along the null space of their two totals (documents
and words), so both totals of the source stay exactly as expected until at most two units are
left. It runs in parallel over blocks of at most about BLOCK units of one source; what the blocks
leave runs again, until one block per source is left. There the last LANDING units or fewer are
the landing problem: of their outcomes the one nearest to the expected totals is taken.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share SHARE of all
words; no target is above twice its source's size, what is above is shared again by weight.

Rows that agree in doc_id, source and size are one unit and get the same number of copies; a
null doc_id or source is a value like others. A null text has size 0. An empty source (or one of
empty texts) has target 0 and nothing is taken from it. Random steps depend only on the unit's
values, so reruns agree at any partitioning. Extra columns are kept by mix() and not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Store, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 2000
LANDING = 14


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, one row per source. sizes: source, source_size.

    The windows run over one row per source. Sorted by the level at which a source is full, a
    source is full if the level of those not yet full reaches its own.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * float(most)).withColumn("all", F.sum("source_size").over(W.partitionBy()) * float(share))
    level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(level), F.lit(0.0))
    out = out.withColumn("full", F.col("cap") * rest <= F.col("weight") * (F.col("all") - F.coalesce(F.sum("cap").over(level), F.lit(0.0))))
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(W.partitionBy())
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(W.partitionBy())
    return out.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("all") - used) / open_).alias("target"))


def _step(p: list[float], at: list[int], n: list[float], t: list[float], rng) -> None:
    """Move the units at (three, or two of equal ratio) along the null space until one is decided."""
    i, j = at[0], at[1]
    if len(at) == 3:
        k = at[2]
        u = [n[j] * t[k] - n[k] * t[j], n[k] * t[i] - n[i] * t[k], n[i] * t[j] - n[j] * t[i]]
        if not any(u):
            u = [n[j], -n[i], 0.0]
    else:
        u = [n[j], -n[i]]
    up = down = float("inf")
    for x, a in zip(u, at, strict=True):
        if x > 0:
            up, down = min(up, (1 - p[a]) / x), min(down, p[a] / x)
        elif x < 0:
            up, down = min(up, p[a] / -x), min(down, (1 - p[a]) / -x)
    move = up if rng.random() * (up + down) < down else -down
    for x, a in zip(u, at, strict=True):
        v = p[a] + move * x
        p[a] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v


def flight(p: list[float], n: list[float], t: list[float], rng, leave: int) -> None:
    """Decide units in place until at most leave (2 at least) are fractional.

    n and t: the rows and words of a unit.
    """
    waiting = [i for i in reversed(range(len(p))) if 0 < p[i] < 1]
    held: list[int] = []
    while len(waiting) + len(held) > leave:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3 and (len(held) < 2 or n[held[0]] * t[held[1]] != n[held[1]] * t[held[0]]):
            return
        _step(p, held, n, t, rng)
        held = [i for i in held if 0 < p[i] < 1]


def land(p: list[float], n: list[float], t: list[float]) -> None:
    """Decide the fractional units so that words, and then documents, are nearest to what was expected."""
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    if not open_:
        return
    at = np.array(open_)
    q, rows, words = np.array(p)[at], np.array(n)[at], np.array(t)[at]
    outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    words_off = np.abs(outcomes @ words - q @ words) / max(words.mean(), 1e-9)
    rows_off = np.abs(outcomes @ rows - q @ rows) / max(rows.mean(), 1e-9)
    best = outcomes[np.argmin(words_off + 0.01 * rows_off)]
    for i, x in zip(open_, best.tolist(), strict=True):
        p[i] = float(x)


def _fly(key, rows: pa.Table, turn: int) -> pa.Table:
    """One block; if it is its source's only one, the landing too."""
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
    p, n = rows["p"].to_pylist(), [float(x) for x in rows["n"].to_pylist()]
    t = [a * b for a, b in zip(rows["size"].to_pylist(), n, strict=True)]
    source, block, blocks = (x.as_py() for x in key)
    rng = np.random.default_rng([turn, block, zlib.crc32((source or "").encode()), source is None])
    if blocks == 1:
        flight(p, n, t, rng, LANDING)
        land(p, n, t)
    else:
        flight(p, n, t, rng, 2)
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _flyer(turn: int, names: list[str]):
    def fly(key, rows):
        return _fly(key, rows, turn).select(names)

    return fly


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies: one row per unit of n equal rows."""
    spark = docs.sparkSession
    store = Store(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size(F.col("text")).alias("size"))
    units = store.write(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = store.write(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(F.col("times") + 1e-12)
    part = F.col("times") - F.col("base")
    state = units.join(goals, units["source"].eqNullSafe(goals["source"])).drop(goals["source"]).withColumn("times", times).withColumn("base", base)
    state = state.withColumn("p", F.when(part < 1e-12, 0.0).otherwise(part)).withColumn("h", F.xxhash64("doc_id", "source", "size", F.lit(11)))
    state = state.select("doc_id", "source", "size", "n", "source_size", "target", "base", "p", "h")
    done = []
    for turn in range(64):
        open_ = state.filter("p > 0 AND p < 1")
        done.append(state.filter("p <= 0 OR p >= 1"))
        blocks = store.write(open_.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        dealt = open_.join(blocks, open_["source"].eqNullSafe(blocks["source"])).drop(blocks["source"])
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks")).cast("int"))
        state = store.write(dealt.groupBy("source", "block", "blocks").applyInArrow(_flyer(turn, state.columns), state.schema))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("base") + F.col("p")).cast("int").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as it is taken (0, 1 or 2 times), with their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = decide(docs).select("doc_id", "source", "size", "copies").filter("copies > 0")
    doc_id, source, text = (F.col(f"c{names.index(x)}") for x in ("doc_id", "source", "text"))
    same = doc_id.cast("long").eqNullSafe(F.col("doc_id")) & source.cast("string").eqNullSafe(F.col("source")) & size(text).eqNullSafe(F.col("size"))
    met = plain.join(found, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return met.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
