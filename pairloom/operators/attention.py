"""A graph-attention autoencoder of cells, trained on blocks of cells with their two-hop surroundings.

    p_i = x_i W1    u_ji = sigmoid(p_j s + p_i t)    a_ji = softmax of u_ji over the edges into i (a loop among them)
    h_i = elu(sum_j a_ji p_j)    z_i = h_i W2    x^_i = elu(sum_j a_ji z_j W2') W1'

The loss is the mean of (x - x^)^2 over cells and features. What a cell's x^ depends on lies within two edges of it, so a
block that holds its own cells, everything two hops around and the edges between knows the exact loss and gradient of its
own cells: joins deal cells and edges to blocks once, and an epoch is then one pass over the packed blocks without a
shuffle of cells, plus a sum of gradients by slices of parameters. The result does not depend on how cells are dealt, up to rounding.
Parameters (features x hidden, hidden x z, and two vectors) are on the driver and bounded by MOST. A lost
executor costs the blocks it was working on. Training is Adam with decay in the gradient and the norm clipped; each tied matrix
takes two steps an epoch, as encoder and as decoder, each with moments of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .pool import collected

#: Parameters that the driver holds and sends.
MOST = 4_000_000
#: Parameters in a slice when gradients are summed.
SLICE = 4096
NAMES = ("w1", "w2", "s", "t")


def _elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def _slope(y: np.ndarray) -> np.ndarray:
    """The derivative of elu, from its value."""
    return np.where(y > 0, 1.0, y + 1)


def _gather(weight: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """out[at] += weight rows, for sorted or unsorted at."""
    out = np.zeros((n, rows.shape[1]))
    np.add.at(out, at, weight[:, None] * rows)
    return out


def encode(p: dict[str, np.ndarray], x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """Projections, attention and embedding of a block's nodes; exact where all edges into a node and its sources are there."""
    n = len(x)
    proj = x @ p["w1"]
    u = 1 / (1 + np.exp(-(proj @ p["s"])[src] - (proj @ p["t"])[dst]))
    e = np.exp(u)
    a = e / np.bincount(dst, e, n)[dst]
    h = _elu(_gather(a, proj[src], dst, n))
    return {"proj": proj, "u": u, "a": a, "h": h, "z": h @ p["w2"]}


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, src: np.ndarray, dst: np.ndarray, own: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The sum of squares over the nodes `own`, and its gradient; w1 and w2 apart as encoder and as decoder (w1d, w2d)."""
    n, w1, w2 = len(x), p["w1"], p["w2"]
    f = encode(p, x, src, dst)
    mine = np.zeros(n, bool)
    mine[own] = True
    last = np.flatnonzero(mine[dst])  # edges that the decoder of own nodes uses
    ls, ld = src[last], dst[last]
    back = f["z"] @ w2.T
    h3 = _elu(_gather(f["a"][last], back[ls], ld, n)[own])
    off = h3 @ w1.T - x[own]
    d4 = 2 * off
    d3 = np.zeros((n, w1.shape[1]))
    d3[own] = (d4 @ w1) * _slope(h3)
    dback = _gather(f["a"][last], d3[ld], ls, n)
    da = np.zeros(len(src))
    da[last] = np.einsum("ij,ij->i", d3[ld], back[ls])
    dz = dback @ w2
    dq = (dz @ w2.T) * _slope(f["h"])
    da += np.einsum("ij,ij->i", dq[dst], f["proj"][src])
    mean = np.bincount(dst, f["a"] * da, n)
    dl = f["a"] * (da - mean[dst]) * f["u"] * (1 - f["u"])
    ds, dt = np.bincount(src, dl, n), np.bincount(dst, dl, n)
    dp = _gather(f["a"], dq[dst], src, n) + np.outer(ds, p["s"]) + np.outer(dt, p["t"])
    grads = {"w1": x.T @ dp, "w2": f["h"].T @ dz, "s": ds @ f["proj"], "t": dt @ f["proj"], "w1d": d4.T @ h3, "w2d": dback.T @ f["z"]}
    return float((off**2).sum()), grads


def start(features: int, hidden: int, z: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"w1": (features, hidden), "w2": (hidden, z), "s": (hidden,), "t": (hidden,)}
    return {k: 1.414 * np.sqrt(2 / (s[0] + (s[1] if len(s) > 1 else 1))) * rng.normal(size=s) for k, s in shapes.items()}


class Adam:
    """Steps of all parameters; the norm of all gradients, both roles of the tied ones, is clipped together."""

    def __init__(self, rate: float = 1e-3, decay: float = 1e-4, clip: float = 5.0):
        self.rate, self.decay, self.clip, self.turn, self.m, self.v = rate, decay, clip, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.turn += 1
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        new = {k: v.copy() for k, v in p.items()}
        for k, g in grads.items():
            name = k.removesuffix("d") if k not in NAMES else k
            g = g * min(1.0, self.clip / (norm + 1e-6)) + self.decay * p[name]
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            new[name] -= self.rate * self.m[k] / (1 - 0.9**self.turn) / (np.sqrt(self.v[k] / (1 - 0.999**self.turn)) + 1e-8)
        return new


def packed(cells: DataFrame, edges: DataFrame, values: DataFrame, index: dict[str, int], most: int = 2048) -> DataFrame:
    """One row a block: its nodes, which are its own, the edges into it and into its sources, and the sparse values.

    cells: cell, x, y, section; edges: a, b (each works both ways; others may be sent in as well); values: cell, feature, value.
    Blocks are runs of at most `most` cells along strips of a section, so that they hold few foreign cells.
    """
    sizes = cells.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    strips = F.ceil(F.sqrt(F.col("n") / most))
    strip = F.least(F.floor((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * strips), strips - 1)
    held = cells.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "section").join(sizes, "section").withColumn("strip", strip)
    run = F.floor((F.row_number().over(W.partitionBy("section", "strip").orderBy("y", "cell")) - 1) / most)
    dealt = cut(held.select("cell", F.xxhash64("section", "strip", run).alias("block")))
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("src <> dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(cells.select(F.col("cell").alias("src"), F.col("cell").alias("dst"))).distinct()
    both = cut(both.join(dealt.select(F.col("cell").alias("src")), "src", "left_semi").join(dealt.select(F.col("cell").alias("dst")), "dst", "left_semi"))
    inner = cut(both.join(dealt.withColumnRenamed("cell", "dst"), "dst").select("block", F.col("src").alias("dst")).distinct())  # own cells and one hop
    sent = cut(both.join(inner, "dst").select("block", "src", "dst"))
    nodes = sent.select("block", F.col("src").alias("cell")).distinct().join(dealt.withColumnRenamed("block", "home"), "cell")
    table = cells.sparkSession.createDataFrame(list(index.items()), "feature string, at int")
    sparse = values.filter("value <> 0").select("cell", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value")).join(F.broadcast(table), "feature")  # as many rows as features, checked
    sparse = sparse.groupBy("cell").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))
    rows = nodes.join(sparse, "cell", "left").select("block", "cell", (F.col("home") == F.col("block")).alias("own"), "at", "value")
    schema = "block long, cell array<long>, own array<boolean>, row array<int>, at array<int>, value array<double>, src array<int>, dst array<int>"

    def each(key, t, e):
        t = t.sort_by("cell")
        cell = t["cell"].to_numpy()
        lists = t["at"].combine_chunks()
        length = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(int)
        row = np.repeat(np.arange(len(cell), dtype=np.int32), length)
        ends = sorted(zip(np.searchsorted(cell, e["dst"].to_numpy()).tolist(), np.searchsorted(cell, e["src"].to_numpy()).tolist(), strict=True))
        one = {"block": key[0].as_py(), "cell": cell, "own": t["own"].to_pylist(), "row": row, "at": lists.flatten().to_numpy(), "value": t["value"].combine_chunks().flatten().to_numpy(), "src": [s for _, s in ends], "dst": [d for d, _ in ends]}
        kinds = {"block": pa.int64(), "cell": pa.list_(pa.int64()), "own": pa.list_(pa.bool_()), "row": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "value": pa.list_(pa.float64()), "src": pa.list_(pa.int32()), "dst": pa.list_(pa.int32())}
        return pa.table({k: pa.array([one[k]], v) for k, v in kinds.items()})

    blocks = rows.groupBy("block").cogroup(sent.select(F.col("block").alias("of"), "src", "dst").groupBy("of")).applyInArrow(each, schema)
    return cut(blocks)


def _block(batch: pa.RecordBatch, i: int, features: int) -> tuple[np.ndarray, ...]:
    def get(name):
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

    x = np.zeros((len(get("cell")), features))
    x[get("row"), get("at")] = get("value")
    return x, get("src").astype(int), get("dst").astype(int), np.flatnonzero(get("own")), get("cell")


def gradient(blocks: DataFrame, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """The summed loss and gradient over all blocks, by one pass and a sum over slices of parameters."""
    sent = blocks.sparkSession.sparkContext.broadcast(p)  # at most MOST numbers
    features = len(p["w1"])

    def each(batches):
        total, loss = None, 0.0
        for b in batches:
            for i in range(b.num_rows):
                x, src, dst, own, _ = _block(b, i, features)
                one, grads = loss_and_gradient(sent.value, x, src, dst, own)
                flat = np.concatenate([grads[k].ravel() for k in sorted(grads)])
                total, loss = flat if total is None else total + flat, loss + one
        if total is not None:
            flat = np.append(total, loss)
            cuts = [flat[i : i + SLICE] for i in range(0, len(flat), SLICE)]
            for i, part in enumerate(cuts):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "v": pa.array([part], pa.list_(pa.float64()))})

    def added(key, t):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0)], pa.list_(pa.float64()))})

    sums = blocks.mapInArrow(each, "slice int, v array<double>").groupBy("slice").applyInArrow(added, "slice int, v array<double>")
    got = sorted(collected(sums, 2 * MOST // SLICE + 2), key=lambda r: r["slice"])
    flat = np.concatenate([np.array(r["v"]) for r in got])
    shapes = {k: p[k.removesuffix("d") if k not in NAMES else k].shape for k in ("s", "t", "w1", "w1d", "w2", "w2d")}
    out, at = {}, 0
    for k, shape in shapes.items():
        size = int(np.prod(shape))
        out[k], at = flat[at : at + size].reshape(shape), at + size
    sent.unpersist()
    return float(flat[-1]), out


@dataclass
class Fit:
    embedding: DataFrame  # cell, z array<double>
    parameters: dict[str, np.ndarray]
    losses: list[float]  # mean squared error before each step, and after the last


def fit(cells: DataFrame, edges: DataFrame, values: DataFrame, hidden: int = 512, z: int = 30, epochs: int = 1000, rate: float = 1e-3, decay: float = 1e-4, seed: int = 0, most: int = 2048) -> Fit:
    """cells: cell (long), x, y, section; edges: a, b; values: cell, feature, value, missing ones 0. Cells without values are trained on as zeros; values of
    unknown cells and edges to them count for nothing; an edge given twice counts once. No cells or no features: no rows, no losses."""
    names = sorted(r[0] for r in collected(values.select(F.col("feature").cast("string")).distinct(), MOST // hidden))
    spark = cells.sparkSession
    n = cells.count()
    p = start(max(len(names), 1), hidden, z, seed)
    if not n or not names:
        return Fit(spark.createDataFrame([], "cell long, z array<double>"), p, [])
    if sum(v.size for v in p.values()) > MOST:
        raise ValueError(f"more than {MOST} parameters; choose variable features first")
    blocks = packed(cells, edges, values, {x: i for i, x in enumerate(names)}, most)
    each, adam, losses = n * len(names), Adam(rate, decay), []
    for turn in range(epochs + 1):
        total, grads = gradient(blocks, p)
        losses.append(total / each)
        if turn < epochs:
            p = adam.step(p, {k: g / each for k, g in grads.items()})
    return Fit(embed(blocks, p), p, losses)


def embed(blocks: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """cell, z of the blocks' own cells."""
    features = len(p["w1"])

    def each(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, src, dst, own, cell = _block(b, i, features)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell[own], pa.int64()), "z": pa.array(list(encode(p, x, src, dst)["z"][own]), pa.list_(pa.float64()))})

    return blocks.mapInArrow(each, "cell long, z array<double>")
