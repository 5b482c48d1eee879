"""Permutation tests of Moran's I for sections of any size, all shuffles or curtailed.

Cells are shuffled within sections. A shuffle depends on the seed, the section and its number alone, so it is the same for every
feature, in whatever order and task it is drawn. Values are packed once, as rows of cells by features of one or two bytes a number where that loses
nothing, and so are contacts. Work is dealt by (section, block of features, range of shuffles): a task holds the section's contacts and the
values of as many features as keep cells x features below NUMBERS, and multiplies ROWS contacts' rows at once, in four-byte floats where sums of
whole counts stay exact. In the curtailed test a state table says after each step of shuffles which features are settled: those whose count of
shuffles at or above the observed one already forbids rejection, and those that the shuffles left could no longer keep from it.
Only the others go on, so the verdict is that of all shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled
from .pool import collected
from .shuffles import EXACT, ROWS, _columns, _narrow

#: Cells times features that one task holds, and that are packed in one row; cells of a row of packed contacts, on average.
NUMBERS, PIECE, ENDS = 1 << 23, 1 << 20, 1 << 17
#: Shuffles of a task, at least where its numbers (shuffles x (cells + two a contact) x features) are so many; numbers of permuted degrees that are multiplied at once.
CHUNK, WORK, DEGREES = 200, 1 << 31, 1 << 22
STEPS = (100, 100, 200, 400, 400, 800)


@dataclass
class Placed:
    """Packed values and contacts. pieces: section, n, block (-1: contacts), base (the block's first feature), piece, kind, width, data, s, q."""

    names: list[str]
    tasks: int
    cells: int
    links: int
    pieces: DataFrame

    def side(self) -> DataFrame:
        """at, feature, s, q: each feature's sum and sum of squares."""
        flat = self.pieces.filter("block >= 0").select("base", F.posexplode(F.arrays_zip("s", "q")).alias("i", "e")).select((F.col("base") + F.col("i")).alias("at"), "e.s", "e.q")
        named = flat.sparkSession.createDataFrame(list(enumerate(self.names)), "at int, feature string")
        return flat.groupBy("at").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).join(F.broadcast(named), "at")  # as many rows as features, checked


def _pack_values(plan: dict[int, tuple[int, int, int]], features: int):
    def each(key, t):
        section, block, piece = (k.as_py() for k in key)
        n, per, rows = plan[section]
        m = np.zeros((min(rows, n - piece * rows), min(per, features - block * per)))
        m[t["rank"].to_numpy() - piece * rows, t["col"].to_numpy()] = t["v"].to_numpy()
        kind, packed = _narrow(m)
        return _piece(section, n, block, block * per, piece * rows, kind, m.shape[1], packed.tobytes(), m.sum(0), (m * m).sum(0))

    return each


def _pack_ends(plan: dict[int, tuple[int, int, int]]):
    def each(key, t):
        section, piece = (k.as_py() for k in key)
        ra, rb = t["ra"].to_numpy(), t["rb"].to_numpy()
        order = np.lexsort((rb, ra))  # rows of one cell are read one after another
        return _piece(section, plan[section][0], -1, 0, piece, "i4", 2, np.stack([ra[order], rb[order]]).astype(np.int32).tobytes(), np.zeros(0), np.zeros(0))

    return each


def _piece(*row):
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.table({c: pa.array([v], k) for c, v, k in zip(("section", "n", "block", "base", "piece", "kind", "width", "data", "s", "q"), row, types, strict=True)})


PIECES = "section long, n int, block int, base int, piece int, kind string, width int, data binary, s array<double>, q array<double>"


def placed(edges: DataFrame, cells: DataFrame, counts: DataFrame) -> Placed:
    """Cells by their rank within the section; loops, and contacts across sections, count for nothing."""
    spark = cells.sparkSession
    ranks = settled(cells.select(F.col("section").cast("long").alias("section"), "cell", (F.row_number().over(W.partitionBy("section").orderBy("cell")) - 1).cast("int").alias("rank")))
    sizes = {r["section"]: r["n"] for r in collected(ranks.groupBy("section").agg(F.count(F.lit(1)).alias("n")), 100_000)}
    counts = settled(counts.filter("feature IS NOT NULL").select("cell", F.col("feature").cast("string").alias("feature"), F.col("count").cast("double").alias("v")).join(ranks, "cell"))
    names = sorted(r[0] for r in collected(counts.select("feature").distinct(), 100_000))
    per = {s: max(1, min(len(names), NUMBERS // n)) for s, n in sizes.items()}
    plan = {s: (n, per[s], max(1, PIECE // per[s])) for s, n in sizes.items()}
    dealt = F.broadcast(spark.createDataFrame([(s, k, rows, -(-n // ENDS)) for s, (n, k, rows) in plan.items()], "section long, per int, rows int, parts int"))  # a row a section
    at = F.broadcast(spark.createDataFrame(list(enumerate(names)), "at int, feature string"))
    values = counts.join(at, "feature").join(dealt, "section")
    values = values.select("section", F.floor(F.col("at") / F.col("per")).cast("int").alias("block"), F.floor(F.col("rank") / F.col("rows")).cast("int").alias("piece"), "rank", (F.col("at") % F.col("per")).alias("col"), "v")
    one, two = (ranks.select("section", F.col("cell").alias(c), F.col("rank").alias(f"r{c}")) for c in "ab")
    ends = edges.select("a", "b").filter("a <> b").join(one, "a").join(two, ["b", "section"]).join(dealt, "section")
    ends = ends.select("section", F.pmod(F.xxhash64("ra"), F.col("parts")).cast("int").alias("piece"), "ra", "rb")
    packed = values.groupBy("section", "block", "piece").applyInArrow(_pack_values(plan, len(names)), PIECES)
    pieces = settled(packed.unionByName(ends.groupBy("section", "piece").applyInArrow(_pack_ends(plan), PIECES)))
    tasks = sum(-(-len(names) // k) for k in per.values())
    links = pieces.filter("block < 0").agg(F.sum(F.length("data"))).first()[0] or 0
    return Placed(names, tasks, sum(sizes.values()), links // 8, pieces)


def keyed(seed: int) -> Callable[[int, int, int, int], Iterator[np.ndarray]]:
    """Orders of a section's n cells for shuffles first <= k < last, each from (seed, section, k); 0 is the observed order."""

    def orders(section, n, first, last):
        for k in range(first, last):
            yield np.random.default_rng([seed, section, k]).permutation(n) if k else np.arange(n)

    return orders


def streamed(seed: int) -> Callable[[int, int, int, int], Iterator[np.ndarray]]:
    """The same, one after another from (seed, section); those before the first are drawn and passed over."""

    def orders(section, n, first, last):
        rng = np.random.default_rng([seed, section])
        for k in range(last):
            order = rng.permutation(n) if k else np.arange(n)
            if k >= first:
                yield order

    return orders


def _held(t: pa.Table, columns: np.ndarray, n: int) -> np.ndarray:
    """The rows of all cells for these columns of the block, filled up to a multiple of 32 bytes."""
    kinds = t["kind"].to_pylist()
    kind = max(kinds, key=["u1", "u2", "f8"].index)
    unit = 32 // np.dtype(kind).itemsize
    x = np.zeros((n, -(-len(columns) // unit) * unit), kind)
    for own, start, width, data in zip(kinds, t["piece"].to_pylist(), t["width"].to_pylist(), t["data"], strict=True):
        m = np.frombuffer(data.as_buffer(), own).reshape(-1, _columns(width, own))
        x[start : start + len(m), : len(columns)] = m[:, columns]
    return x


def _products(v: np.ndarray, a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Sums by column of the products of the rows a and b of v, whose numbers are at most top."""
    exact = 0 if v.dtype.kind == "f" else int(min(EXACT, (2**24 - 1) // max(top * top, 1)))
    ones, out = np.ones(max(exact, 1), np.float32), np.zeros(v.shape[1])
    for at in range(0, len(a), ROWS):
        x, y = (v.take(r[at : at + ROWS], axis=0, mode="clip") for r in (a, b))
        if exact >= 8:
            x = np.multiply(x, y, dtype=np.float32)
            full = len(x) // exact * exact
            out += (ones @ x[:full].reshape(-1, exact, x.shape[1])).sum(0, dtype=np.float64) + x[full:].sum(0, dtype=np.float64)
        else:
            out += np.ones(len(x)) @ np.multiply(x, y, dtype=np.float64)
    return out


def shuffled_sums(p: Placed, orders: Callable, first: int, last: int, chunk: int = CHUNK, only: set[int] | None = None) -> DataFrame:
    """at, perm, xy, sd: over the contacts (from both ends) of all sections, sums of products and of values, for shuffles first <= perm < last and the
    features `only`. A block without values in a section gives nothing."""
    work = (last - first) * (p.cells + 2 * p.links) * len(p.names) // (max(p.tasks, 1) * WORK) + 1
    parts = max(1, min(-(-(last - first) // chunk), work))
    some = None if only is None else np.array(sorted(only), np.int64)

    def each(t):
        section, n, base, part = (t[c][0].as_py() for c in ("section", "n", "base", "part"))
        own = t.filter(pa.compute.greater_equal(t["side"], 0))
        columns = np.arange(own["width"][0].as_py())
        if some is not None:
            columns = columns[np.isin(columns + base, some)]
        if not len(columns):
            return pa.table({"at": pa.array([], pa.int32()), "perm": pa.array([], pa.int32()), "xy": pa.array([], pa.float64()), "sd": pa.array([], pa.float64())})
        x = _held(own, columns, n)
        width, top = len(columns), float(x.max(initial=0))
        met = [np.frombuffer(d.as_buffer(), np.int32).reshape(2, -1) for d in t.filter(pa.compute.less(t["side"], 0)).sort_by("piece")["data"]]
        a, b = np.concatenate(met, axis=1) if met else np.zeros((2, 0), np.int32)
        degree = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)).astype(np.float64)
        low, high = (first + (last - first) * i // parts for i in (part, part + 1))
        xy, sd, batch = np.zeros((high - low, width)), np.zeros((high - low, width)), max(1, DEGREES // max(n, 1))
        moved = np.zeros((min(batch, high - low), n))
        for i, order in enumerate(orders(section, n, low, high)):
            xy[i] = 2 * _products(x.take(order, axis=0), a, b, top)[:width]
            moved[i % batch, order] = degree
            if i % batch == batch - 1 or i == high - low - 1:
                at = i - i % batch
                for r in range(0, n, ROWS):
                    sd[at : i + 1] += moved[: i + 1 - at, r : r + ROWS] @ x[r : r + ROWS, :width].astype(np.float64)
        perms = np.repeat(np.arange(low, high, dtype=np.int32), width)
        return pa.table({"at": pa.array(np.tile((columns + base).astype(np.int32), high - low)), "perm": pa.array(perms), "xy": xy.ravel(), "sd": sd.ravel()})

    rows = p.pieces.filter("block >= 0").drop("s", "q")
    if some is not None and len(some) <= 1000:
        rows = rows.filter(F.exists(F.array(*[F.lit(int(i)) for i in some]), lambda i: (i >= F.col("base")) & (i < F.col("base") + F.col("width"))))
    blocks = rows.select("section", F.col("block").alias("of"), "base").distinct()
    ends = p.pieces.filter("block < 0").drop("s", "q", "base").join(F.broadcast(blocks), "section").select("section", "n", F.col("of").alias("block"), "base", F.lit(-1).alias("side"), "piece", "kind", "width", "data")
    sent = rows.select("section", "n", "block", "base", F.lit(0).alias("side"), "piece", "kind", "width", "data").unionByName(ends).withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
    key = ["section", "block", "part"]
    out = sent.repartition(max(1, min(16 * p.tasks * parts, 4096)), *key).groupBy(*key).applyInArrow(each, "at int, perm int, xy double, sd double")  # tasks are few and long: many partitions keep them apart
    return out.groupBy("at", "perm").agg(F.sum("xy").alias("xy"), F.sum("sd").alias("sd"))


def moran(n: int, w: int) -> Column:
    """Moran's I of the columns s, q, xy, sd."""
    mean = F.col("s") / n if n else F.lit(0.0)
    bottom = F.col("q") - n * mean * mean
    value = n / w * (F.col("xy") - 2 * mean * F.col("sd") + mean * mean * w) / bottom if w else F.lit(float("nan"))
    return F.when(bottom > 1e-12, value).otherwise(float("nan"))


def curtailed_moran(edges: DataFrame, cells: DataFrame, counts: DataFrame, perms: int = 2000, seed: int = 0, alpha: float = 0.05, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """feature, moran, above, shuffles, p = (1 + above) / (1 + shuffles), rejected: whether all perms shuffles give p <= alpha.

    edges: a, b; cells: cell, section; counts: cell, feature, count (missing: 0). Features that do not vary have NaN and no shuffles.
    """
    p = placed(edges, cells, counts.filter("count <> 0"))
    n, w = p.cells, 2 * p.links
    most = int(np.floor(alpha * (1 + perms) - 1 + 1e-9))  # so many shuffles at or above still reject
    value = moran(n, w)
    orders = keyed(seed)
    seen = shuffled_sums(p, orders, 0, 1).select("at", "xy", "sd")
    state = p.side().join(seen, "at", "left").na.fill(0.0, ["xy", "sd"]).select("at", "feature", "s", "q", value.alias("moran"))
    state = settled(state.select("*", F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("shuffles"), (~F.isnan("moran")).alias("open")))
    done = 0
    for step in [*steps, *[steps[-1]] * (max(0, perms - sum(steps)) // steps[-1] + 1)]:
        last = min(perms, done + step)
        going = state.filter("open")
        only = {r["at"] for r in collected(going.select("at"), 100_000)} if last > done else None
        if not only:
            break
        null = shuffled_sums(p, orders, done + 1, last + 1, only=only)
        met = null.join(F.broadcast(going), "at").withColumn("v", value)  # at most as many rows as features
        above = met.groupBy("at").agg(F.count(F.when(F.col("v") >= F.col("moran") - 1e-9 * F.abs("moran") - 1e-12, 1)).alias("more"))
        state = state.join(above, "at", "left")
        total = F.col("above") + F.coalesce("more", F.lit(0))
        shuffles = F.when(F.col("open"), F.lit(last).cast("long")).otherwise(F.col("shuffles"))
        still = F.col("open") & (total <= most) & (total + (perms - last) > most)
        state = settled(state.select("at", "feature", "s", "q", "moran", total.alias("above"), shuffles.alias("shuffles"), still.alias("open")))
        done = last
    share = F.when(F.isnan("moran"), float("nan")).otherwise((1 + F.col("above")) / (1 + F.col("shuffles")))
    return state.select("feature", "moran", "above", "shuffles", share.alias("p"), (~F.isnan("moran") & (F.col("above") <= most)).alias("rejected"))
