"""Components of scaled features from sparse values, and batch correction by diverse soft clusters and ridge regression.

Clusters are soft k-means by cosine with a penalty on clusters whose mix of batches differs from the whole:

    R_ik proportional to exp(-2 (1 - cos(z_i, y_k)) / SIGMA) ((E_kb + 1) / (O_kb + 1))^theta     b: the batch of i

O_kb: what is observed of batch b in cluster k, E_kb: what the cluster's size and the batch's share give. Cells are dealt to BLOCKS by a hash; blocks
take turns, each with O and E counted without it. A pass reads one block and returns sums of clusters x (dimensions + batches) numbers;
cells are neither shuffled nor rewritten while clusters form. Then, for each cluster, a ridge regression of the original components on the batch gives
the batch's offset from grouped sums, which is taken away by R; the table of cells is written once a correction.
What the driver holds is features x features, or clusters x batches x dimensions, both at most MOST.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, settled
from . import pool

MOST = 4_000_000
SLICE = 4096
BLOCKS = 4
# Width of the soft clusters, ridge, and when rounds and corrections end
SIGMA = 0.1
RIDGE = 1.0
CALM = 1e-5
SETTLED = 1e-4


def vector_sum(rows: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of each(batch), vectors of `size` numbers, over all batches: one vector a task, then sums by slices."""
    if size > 2 * MOST:
        raise ValueError(f"more than {2 * MOST} numbers in a sum")

    def parts(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += each(b)
        for i in range(0, size, SLICE):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i // SLICE], pa.int32()), "v": pa.array([total[i : i + SLICE]], pa.list_(pa.float64()))})

    def added(key, t):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.sum([v.values.to_numpy() for v in t["v"]], axis=0)], pa.list_(pa.float64()))})

    got = pool.collected(rows.mapInArrow(parts, "slice int, v array<double>").groupBy("slice").applyInArrow(added, "slice int, v array<double>"), 2 * MOST // SLICE + 1)
    return np.concatenate([np.array(r["v"]) for r in sorted(got, key=lambda r: r["slice"])]) if got else np.zeros(size)


def components(values: DataFrame, cells: DataFrame, k: int, clip: float = 10.0) -> DataFrame:
    """cell, embedding (k numbers) of every cell: principal components of features scaled to variance 1 and clipped above.

    values: cell, feature, value (missing: 0). A zero is the same number in every cell, so only the sparse values' differences from it are
    summed. Features that do not vary drop out; fewer than k give zeros. A component's largest loading is positive.
    """
    cells = cells.select("cell").distinct()
    n = cells.count()
    values = values.select("cell", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value")).filter("value <> 0 AND feature IS NOT NULL").join(cells, "cell")
    by = pool.collected(values.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss")), int(MOST**0.5))
    side = [(r["feature"], r["s"] / n, ((r["ss"] - r["s"] ** 2 / n) / max(n - 1, 1)) ** 0.5) for r in sorted(by, key=lambda r: r["feature"]) if r["ss"] - r["s"] ** 2 / n > 1e-12 * r["ss"]]
    if not side:
        return cells.select("cell", F.array(*[F.lit(0.0)] * k).alias("embedding"))
    f, spark = len(side), cells.sparkSession
    zero = np.minimum(np.array([-m / s for _, m, s in side]), clip)
    table = spark.createDataFrame([(x, i, float(m), float(s), float(z)) for i, ((x, m, s), z) in enumerate(zip(side, zero, strict=True))], "feature string, at int, m double, s double, zero double")
    off = values.join(F.broadcast(table), "feature").select("cell", "at", (F.least((F.col("value") - F.col("m")) / F.col("s"), F.lit(clip)) - F.col("zero")).alias("e"))  # as many rows as features, checked
    lists = cut(off.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("v")).select("cell", F.col("v.at").alias("at"), F.col("v.e").alias("e")))

    def gram(b: pa.RecordBatch) -> np.ndarray:
        row = np.repeat(np.arange(b.num_rows), b["at"].value_lengths().to_numpy())
        at, e, out, total = b["at"].flatten().to_numpy(), b["e"].flatten().to_numpy(), np.zeros((f, f)), np.zeros(f)
        for i in range(0, b.num_rows, 512):
            held = (row >= i) & (row < i + 512)
            x = np.zeros((512, f))
            x[row[held] - i, at[held]] = e[held]
            out, total = out + x.T @ x, total + x.sum(0)
        return np.append(out.ravel(), total)

    flat = vector_sum(lists, gram, f * f + f)
    total = flat[f * f :]
    a = flat[: f * f].reshape(f, f) + np.outer(zero, total) + np.outer(total, zero) + n * np.outer(zero, zero)
    mean = zero + total / n
    load = np.linalg.eigh(a - n * np.outer(mean, mean))[1][:, ::-1][:, :k]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    load = np.hstack([load, np.zeros((f, k - load.shape[1]))])
    base = (zero - mean) @ load

    def scores(batches):
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), b["at"].value_lengths().to_numpy())
            z = np.tile(base, (b.num_rows, 1))
            np.add.at(z, row, b["e"].flatten().to_numpy()[:, None] * load[b["at"].flatten().to_numpy()])
            yield pa.RecordBatch.from_pydict({"cell": b["cell"], "embedding": pa.array(list(z), pa.list_(pa.float64()))})

    got = lists.mapInArrow(scores, f"cell {lists.schema['cell'].dataType.simpleString()}, embedding array<double>")
    return cells.join(got, "cell", "left").select("cell", F.coalesce("embedding", F.array(*[F.lit(float(x)) for x in base])).alias("embedding"))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1)), 1e-12)[:, None]


def soft(u: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """R of unit rows u for unit centres y; penalty: rows x clusters, to be added to the logarithm."""
    logs = -2 * (1 - u @ y.T) / SIGMA + penalty
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def offsets(o: np.ndarray, s: np.ndarray) -> np.ndarray:
    """clusters x batches x dimensions: the batches' coefficients of a ridge regression on intercept and batch, in which only they are shrunk.

    o: clusters x batches sums of R; s: clusters x batches x dimensions sums of R z."""
    out = np.zeros_like(s)
    for k in range(len(o)):
        b = o.shape[1]
        a = np.zeros((b + 1, b + 1))
        a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = o[k].sum(), o[k], o[k], np.diag(o[k] + RIDGE)
        if o[k].sum() > 1e-9:
            out[k] = np.linalg.solve(a, np.vstack([s[k].sum(0), s[k]]))[1:]
    return out


@dataclass
class Fit:
    cells: DataFrame  # cell, batch, embedding (corrected), label (the most likely cluster)
    objectives: list[float]  # after each pass over all blocks
    corrections: int


def _starts(cells: DataFrame, k: int, seed: int, rounds: int) -> np.ndarray:
    """Unit centres of k-means by cosine, from cells chosen apart among 8 k by hash."""
    some = np.array([r["zh"] for r in cells.orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(8 * k).select("zh").collect()])  # starting points
    some = _unit(some)
    chosen = [0]
    while len(chosen) < min(k, len(some)):
        chosen.append(int((some @ some[chosen].T).max(1).argmin()))
    y = some[chosen]
    for _ in range(rounds):

        def each(b: pa.RecordBatch, y=y) -> np.ndarray:
            u = _unit(_rows(b["zh"]))
            out = np.zeros_like(y)
            np.add.at(out, (u @ y.T).argmax(1), u)
            return out.ravel()

        new = vector_sum(cells.select("zh"), each, y.size).reshape(y.shape)
        y = np.where((new**2).sum(1, keepdims=True) > 0, _unit(new), y)
    return y


def correct(cells: DataFrame, k: int = 0, theta: float = 2.0, corrections: int = 10, rounds: int = 20, seed: int = 0, starts: int = 10) -> Fit:
    """cells: cell, batch (string), embedding (same length everywhere). k 0: one cluster for 30 cells, 2 to 100.

    Cells with a null batch, embedding or component are left out; with one batch, or no cells, embeddings stay as they are. Ends after `corrections`, or when the
    objective falls by less than SETTLED of itself; rounds of clustering end when the last three sums moved by less than CALM.
    """
    cells = cells.select("cell", F.col("batch").cast("string").alias("batch"), F.col("embedding").cast("array<double>").alias("z")).filter("batch IS NOT NULL AND z IS NOT NULL AND NOT exists(z, v -> v IS NULL OR isnan(v))")
    cells = cut(cells.withColumn("block", F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(BLOCKS)).cast("int")))
    sizes = {r["batch"]: r["n"] for r in pool.collected(cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n")), 100_000)}
    batches, n = sorted(sizes), sum(sizes.values())
    if len(batches) < 2:
        return Fit(cells.select("cell", "batch", F.col("z").alias("embedding"), F.lit(0).alias("label")), [], 0)
    k = k or int(min(100, max(2, round(n / 30))))
    d, nb = len(cells.first()["z"]), len(batches)
    if k * nb * (d + 1) > MOST:
        raise ValueError(f"more than {MOST} sums of clusters x batches x dimensions")
    share, at = np.array([sizes[b] for b in batches]) / n, {b: i for i, b in enumerate(batches)}
    table = cells.withColumn("zh", F.col("z"))
    y = _starts(table, k, seed, starts)
    k = len(y)

    def index(b):
        return np.array([at[x] for x in b["batch"].to_pylist()])

    def penalties(o: np.ndarray) -> np.ndarray:
        e = np.outer(o.sum(1), share)
        return theta * np.log((e + 1) / (o + 1)).T

    def block_sums(rows: DataFrame, y: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """O and sums of R u of the rows, and what they add to the objective without the penalty."""

        def each(b):
            u, which = _unit(_rows(b["zh"])), index(b)
            r = soft(u, y, penalty[which])
            o = np.zeros((nb, k))
            np.add.at(o, which, r)
            cost = (r * 2 * (1 - u @ y.T)).sum() + SIGMA * (r * np.log(np.maximum(r, 1e-300))).sum()
            return np.concatenate([o.T.ravel(), (r.T @ u).ravel(), [cost]])

        flat = vector_sum(rows.select("batch", "zh"), each, k * nb + k * d + 1)
        return flat[: k * nb].reshape(k, nb), flat[k * nb : -1].reshape(k, d), float(flat[-1])

    objectives: list[float] = []
    whole = None
    held = [block_sums(table.filter(F.col("block") == j), y, np.zeros((nb, k))) for j in range(BLOCKS)]
    for turn in range(corrections):
        seen: list[float] = []
        for _ in range(rounds):
            sums = sum(h[1] for h in held)
            y = np.where((sums**2).sum(1, keepdims=True) > 0, _unit(sums), y)
            used = []
            for j in range(BLOCKS):
                penalty = penalties(sum(h[0] for i, h in enumerate(held) if i != j))
                used.append(penalty)
                held[j] = block_sums(table.filter(F.col("block") == j), y, penalty)
            o = sum(h[0] for h in held)
            e = np.outer(o.sum(1), share)
            seen.append(sum(h[2] for h in held) + SIGMA * theta * float((o * np.log((o + 1) / (e + 1))).sum()))
            if len(seen) > 3 and abs(sum(seen[-4:-1]) - sum(seen[-3:])) < CALM * abs(sum(seen[-4:-1])):
                break
        objectives += seen
        penalty_of, centres = np.array(used), y

        def moments(b):
            which = index(b)
            r, z = soft(_unit(_rows(b["zh"])), centres, penalty_of[b["block"].to_numpy(), which]), _rows(b["z"])
            s = np.zeros((nb, k, d))
            np.add.at(s, which, r[:, :, None] * z[:, None, :])
            return s.transpose(1, 0, 2).ravel()

        w = offsets(o, vector_sum(table.select("batch", "block", "zh", "z"), moments, k * nb * d).reshape(k, nb, d))

        def moved(batches_, w=w, centres=centres, penalty_of=penalty_of):
            for b in batches_:
                if b.num_rows:
                    which = index(b)
                    r, z = soft(_unit(_rows(b["zh"])), centres, penalty_of[b["block"].to_numpy(), which]), _rows(b["z"])
                    new = z - np.einsum("ik,ikd->id", r, w[:, which].transpose(1, 0, 2))
                    yield pa.RecordBatch.from_pydict({"cell": b["cell"], "batch": b["batch"], "z": b["z"], "block": b["block"], "zh": pa.array(list(new), pa.list_(pa.float64())), "label": pa.array(r.argmax(1).astype(np.int32)), "r": pa.array(list(r), pa.list_(pa.float64()))})

        schema = f"cell {cells.schema['cell'].dataType.simpleString()}, batch string, z array<double>, block int, zh array<double>, label int, r array<double>"
        table = settled(table.select("cell", "batch", "z", "block", "zh").mapInArrow(moved, schema))
        if turn and whole - seen[-1] < SETTLED * abs(whole):
            break
        whole = seen[-1]

        def resumed(b):
            return np.concatenate([(_rows(b["r"]).T @ _unit(_rows(b["zh"]))).ravel()])

        # the next clusters start from the present R and the corrected cells
        held = [(h[0], vector_sum(table.filter(F.col("block") == j).select("zh", "r"), resumed, k * d).reshape(k, d), h[2]) for j, h in enumerate(held)]
    return Fit(table.select("cell", "batch", F.col("zh").alias("embedding"), "label"), objectives, turn + 1)
