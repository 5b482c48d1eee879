"""Near-duplicate vectors by spherical-cap filters.

Only vectors of equal label (not null) and length are compared, by cosine in double precision.
Filter directions are products of random codes: a vector's coordinates are cut into PIECES, each
piece has its own seeded code of unit vectors, and a direction is one code vector per piece. A
vector is list-decoded to all directions whose inner product with it reaches its cap's height, the
n-th largest product it has (a fixed height would leave half of the vectors with hardly any
direction, as sums of few products vary much by vector). Of two sorted lists of partial sums only
the pairs (i, j) with i * j <= n can be among these, so the other directions are never listed.
The number of directions grows with the rows, and n with its logarithm (listed), as a pair's chance to
share one of n would fall otherwise; vectors that share one are compared exactly.

Equal vectors of a label are one class with a weight. Directions with one class are dropped before
any vector is sent. A direction with more than CHUNK classes is dealt to tasks by pairs of chunks,
so no task holds more than two. A pair that meets under several directions counts under the least
of them, so links are counted without listing pairs; each task returns its vectors' partial
counts and a forest of the links it found. Nothing is capped; a link is missed only if its two
vectors share no direction (simulated at 0.98 in 64 dimensions: of 3,000 pairs, 0 to 2 are missed
with 2^13 to 2^27 classes a label).

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links
0, component_id their own vec_id. A null vec_id is never the smallest id if there is another.
Repeated rows are copies of each other. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, by_key, components, table

COSINE = 0.98
LIST = 24
#: From 2^FEW rows of a label on, each doubling lengthens the list by MORE directions.
FEW, MORE = 14, 6
CHUNK = 1500


def _pack(batches):
    for b in batches:
        lists = b.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
        ends = np.cumsum(lengths)
        out = []
        for n, z in zip(lengths.tolist(), ends.tolist(), strict=True):
            v = flat[z - n : z]
            out.append(v.tobytes() if n and np.isfinite(v).all() and v.any() else None)
        yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary()), pa.array(lengths.astype(np.int32))], names=["vec_id", "label", "vec", "dim"])


def unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


@functools.lru_cache(4)
def codes(dim: int, rows: int) -> tuple[tuple[np.ndarray, ...], tuple[int, ...]]:
    """(the pieces' codes, where pieces begin and end)."""
    pieces = 4 if dim >= 32 else 2 if dim >= 8 else 1
    each = 2
    while each**pieces < 12 * max(rows, 64):
        each += 1
    edges = np.linspace(0, dim, pieces + 1).round().astype(int)
    made = []
    for k in range(pieces):
        c = np.random.default_rng([dim, k, 3]).normal(size=(each, edges[k + 1] - edges[k]))
        made.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return tuple(made), tuple(edges.tolist())


def listed(rows: int) -> int:
    """The number of directions a vector is decoded to."""
    return LIST + MORE * max(0, (rows - 1).bit_length() - FEW)


def _first(sums: np.ndarray, n: int) -> np.ndarray:
    """Where the n largest of each row are, largest first."""
    n = min(n, sums.shape[1])
    at = np.argpartition(-sums, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(sums, at, 1), axis=1, kind="stable")
    return np.take_along_axis(at, order, 1)


def decode(x: np.ndarray, rows: int) -> np.ndarray:
    """The numbers of the listed(rows) directions nearest to each unit vector, in ascending order."""
    n = listed(rows)
    made, edges = codes(x.shape[1], rows)
    parts = [x[:, a:z] @ c.T for a, z, c in zip(edges[:-1], edges[1:], made, strict=True)]
    if len(parts) == 4:
        parts = [(parts[i][:, :, None] + parts[i + 1][:, None, :]).reshape(len(x), -1) for i in (0, 2)]
    if len(parts) == 1:
        return np.sort(_first(parts[0], n), axis=1)
    tops = [_first(p, n) for p in parts]
    left, right = (np.take_along_axis(p, t, 1) for p, t in zip(parts, tops, strict=True))
    i, j = np.nonzero(np.outer(np.arange(1, left.shape[1] + 1), np.arange(1, right.shape[1] + 1)) <= n)
    best = _first(left[:, i] + right[:, j], n)
    return np.sort(np.take_along_axis(tops[0], i[best], 1) * parts[1].shape[1] + np.take_along_axis(tops[1], j[best], 1), axis=1)


def _decoder(rows: int):
    def each(batches):
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            found: list = [None] * len(dims)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), 512):
                    pick = own[at : at + 512]
                    for i, f in zip(pick.tolist(), decode(unit([b.column("vec")[int(i)].as_py() for i in pick]), rows), strict=True):
                        found[i] = f
            yield pa.record_batch([*b.columns, pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], names=[*b.schema.names, "caps"])

    return each


def _earlier(caps: list[np.ndarray], own: int) -> np.ndarray:
    """Which vectors exceed which of the lesser directions that two of them share."""
    flat = np.concatenate(caps)
    who = np.repeat(np.arange(len(caps)), [len(c) for c in caps])
    less = flat < own
    names, at, n = np.unique(flat[less], return_inverse=True, return_counts=True)
    keep = n[at] > 1
    columns = np.cumsum(n > 1) - 1
    out = np.zeros((len(caps), int((n > 1).sum())), np.float32)
    out[who[less][keep], columns[at[keep]]] = 1
    return out


def _forest(link: np.ndarray) -> np.ndarray:
    """Each row's root: the least row it reaches by the symmetric link."""
    root = np.arange(len(link))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(batches):
    """One direction's vectors (or two chunks of them) at a time: partial counts and forest edges."""
    for (_, _, cap, one, two), t in by_key(batches, ["label", "dim", "cap", "one", "two"]):
        x = unit(t["vec"].to_pylist())
        early = _earlier([np.asarray(c, np.int64) for c in t["caps"].to_pylist()], cap)
        weight, rid, chunk = t["m"].to_numpy().astype(np.float64), t["rid"].to_numpy(), t["chunk"].to_numpy()
        link = (x @ x.T >= COSINE) & (early @ early.T == 0)
        np.fill_diagonal(link, False)
        if one != two:  # within one chunk another task compares
            link &= chunk[:, None] != chunk[None, :]
        if link.any():
            root = _forest(link)
            has = np.flatnonzero(link.any(axis=1))
            yield pa.record_batch([pa.array(rid[has]), pa.array(rid[root[has]]), pa.array((link @ weight)[has].astype(np.int64))], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    store = Store(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.mapInArrow(_pack, "vec_id long, label long, vec binary, dim int").withColumn("rid", F.when(F.col("label").isNotNull(), F.xxhash64("vec", "label", "dim")).otherwise(None))
    rows = store.write(rows.withColumn("rid", F.when(F.col("vec").isNotNull(), F.col("rid"))))
    classes = rows.filter("rid IS NOT NULL").groupBy("rid", "label", "dim", "vec").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    classes = store.write(classes)
    most = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    size = 1 << max(6, int(most).bit_length())
    decoded = store.write(classes.select("rid", "label", "dim", "vec", "m").mapInArrow(_decoder(size), "rid long, label long, dim int, vec binary, m long, caps array<long>"))
    each = decoded.select("rid", "label", "dim", F.explode("caps").alias("cap"))
    shared = each.groupBy("label", "dim", "cap").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = store.write(each.join(shared, ["label", "dim", "cap"]))
    parts = F.ceil(F.col("c") / CHUNK).cast("int")
    met = met.withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(9)), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("rid", "cap", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"))
    sent = met.join(decoded, "rid").repartition("label", "dim", "cap", "one", "two").sortWithinPartitions("label", "dim", "cap", "one", "two")
    found = store.write(sent.select("label", "dim", "cap", "one", "two", "chunk", "rid", "m", "vec", "caps").mapInArrow(_compare, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    reach = store.write(components(store, found.select("a", "b")))
    merged = classes.select("rid", "m", "least").join(reach.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    ends = merged.groupBy("component").agg(F.min("least").alias("component_id"))
    known = merged.join(ends, "component").join(links, "rid", "left").select("rid", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "rid").join(known, "rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("rid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs of a label, for small tables.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
c AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
l AS (SELECT x, y FROM c WHERE c >= 0.98 AND NOT isnan(c)),
r AS (SELECT vec_id AS d, vec_id AS c FROM v UNION SELECT r.d, l.y FROM r JOIN l ON r.c = l.x),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY 1), k AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON vec_id = d LEFT JOIN k ON vec_id = x
"""
QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLES = {"op8_embedding_dedup": SQL}
