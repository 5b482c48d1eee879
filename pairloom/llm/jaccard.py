"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles; two link when their Jaccard similarity is at
least percent / 100. Sets are put into bands of nearly equal size, and for each band the similarity
bounds the Hamming distance of two sets by k. The feature domain (the shingles' hash) is cut into
first-level parts and each of these into PARTS second-level parts. A set's signatures are, for each
first-level part, its shingles in every subset of PARTS - LEFT_OUT second-level parts. First-level
parts with at most LEFT_OUT differing shingles have a subset without any; there are so many parts
that similar sets share several signatures. A set signs for its own band, and for the next one if a
set there can be similar enough. Subsets without shingles make no signature; sets with too many
such subsets to be sure of a shared one sign them too. So similar sets always share at least
`need` signatures, a number that is known for each set (signatures()), and it is enough to meet
under the rarest m - need + 1 of the m that a set shares with any other (_rarest()).

Only components are wanted, so pairs are not listed:
1. equal sets are one node from the start;
2. the least node of a signature is its hub; a node is sent once to each hub that it shares a
   signature with, not once for each signature;
3. at a hub, all pairs of nodes whose components are apart are looked at, in blocks: by size and by
   sketches of parities, wider than the sets are large, which never differ in more bits than the
   sets do. So a similarity a little below the asked one is excluded;
4. in ROUNDS rounds (the first over each node's best hub, the others over all) a spanning forest of the
   likeliest pairs leaves the task, is compared by whole sets, and those that are similar join
   components; so groups of copies cost as many comparisons as nodes in a round. A hub all of whose pairs
   are in one component, excluded or in the forest is done and not looked at again;
5. at last all pairs of the other hubs that are still apart and not excluded are compared.
Every comparison that links is exact over whole sets.

A document without words or text has an empty set: 0 shingles, linked with nothing, a component of
its own. A null doc_id is never the smallest id if there is another; rows with one doc_id and
different texts are nodes of their own. Repeated rows are linked. Extra columns are not read by
link(); keep_one() keeps them. Nodes are 64-bit hashes of whole sets.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel
from .common import Store, bounded_batches, components, table

RATIO = 1.3
#: Second-level parts of a first-level part, and how many of them a subset leaves out.
PARTS, LEFT_OUT = 3, 1
SUBSETS = list(itertools.combinations(range(PARTS), PARTS - LEFT_OUT))
#: First-level parts beyond those that the distance asks for and beyond those expected to be too empty.
EXTRA = 2
#: Rounds in which a forest of the likeliest pairs is compared, before all pairs that are apart and not excluded are.
ROUNDS = 3
#: Nodes of one hub that a task compares at once; more are dealt by pairs of chunks.
GROUP = 512
#: Pairs whose sketches a task compares at once, and bytes of rows whose groups it holds.
PAIRS, HELD = 1 << 18, 8 << 20
#: So many nodes (24 bytes each) are broadcast to the texts at most; more are joined by shuffling both sides.
SENT = 1 << 20
_U = np.uint64


@functools.lru_cache(8)
def bands(percent: int) -> dict[str, np.ndarray]:
    """By band: its least and largest size, the largest distance of its pairs, its first-level parts; 0 parts: only equal sets link."""
    out = {"low": [0], "high": [0], "k": [0], "first": [0]}
    low = 1
    while low < 1 << 40:
        high = max(low, int(low * RATIO))
        k = distance(high, high, percent)
        first = k // (LEFT_OUT + 1) + 1
        empty = math.exp(-low / (first * PARTS))  # the chance of a second-level part to be empty
        rest = PARTS - LEFT_OUT
        risky = sum(math.comb(PARTS, j) * empty**j * (1 - empty) ** (PARTS - j) for j in range(rest, PARTS + 1))
        first += EXTRA + math.ceil(risky * first)
        for name, x in (("low", low), ("high", high), ("k", k), ("first", first if k else 0)):
            out[name].append(x)
        low = high + 1
    return {k: np.array(v, np.int64) for k, v in out.items()}


def distance(a, b, percent: int):
    """The largest Hamming distance of similar sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def node(shingles: np.ndarray) -> int | None:
    """The set's number; none for the empty set."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        total = kernel.mix(shingles).sum(dtype=_U) + _U(len(shingles)) * _U(0x9E3779B97F4A7C15)
    return int(kernel.mix(np.array([total], _U)).view(np.int64)[0])


def _code(band, first, subset) -> np.ndarray:
    return kernel.mix((np.asarray(band).astype(_U) << _U(48)) + np.asarray(first).astype(_U) * _U(len(SUBSETS)) + _U(subset))


def _named(total: np.ndarray, code: np.ndarray, band) -> np.ndarray:
    """Signatures from a subset's content and place; the last bit says whether the band is odd."""
    return (kernel.mix(total + code) & ~_U(1)) | (np.asarray(band).astype(_U) & _U(1))


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, which set) for all signatures of the sets; and for each set the least number of
    signatures that it shares with a similar set in its even and in its odd band (0: it signs for none)."""
    b = bands(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(b["high"], sizes, "left")
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    weight = kernel.mix(flat ^ _U(0xA5A5A5A5DEADBEEF))
    who = np.repeat(np.arange(len(sets)), sizes)
    need = np.zeros((len(sets), 2), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        band = own + step
        first, k = b["first"][band], b["k"][band]
        on = (first > 0) & (sizes > 0)
        if step:
            on &= percent * b["low"][band] <= 100 * sizes
        pick = on[who]
        if not pick.any():
            continue
        w, h = who[pick], flat[pick]
        part = ((h >> _U(32)) * (first[w] * PARTS).astype(_U)) >> _U(32)  # sorted hashes: a part is a run of them
        starts = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (part[1:] != part[:-1]))))
        total = np.add.reduceat(weight[pick], starts)
        w, part = w[starts], part[starts].astype(np.int64)
        above = part // PARTS
        turn = np.concatenate(([True], (w[1:] != w[:-1]) | (above[1:] != above[:-1])))
        at = np.cumsum(turn) - 1
        w, above = w[turn], above[turn]
        sums = np.zeros((len(w), PARTS), _U)
        sums[at, part % PARTS] = total
        filled = np.zeros((len(w), PARTS), bool)
        filled[at, part % PARTS] = True
        has = np.stack([filled[:, s].any(axis=1) for s in SUBSETS])
        sound = np.bincount(w[has.all(axis=0)], minlength=len(sets))
        shared = np.where(on, (LEFT_OUT + 1) * sound - k, 0)
        rows = np.flatnonzero(on)
        need[rows, band[rows] % 2] = np.maximum(shared[rows], 1)
        for j, s in enumerate(SUBSETS):
            x, f = w[has[j]], above[has[j]]
            found.append((_named(sums[has[j]][:, s].sum(axis=1, dtype=_U), _code(band[x], f, j), band[x]), x))
        for i in np.flatnonzero(on & (shared < 1)):
            for j in range(len(SUBSETS)):
                empty = np.setdiff1d(np.arange(first[i]), above[(w == i) & has[j]])
                found.append((_named(_U(0), _code(band[i], empty, j), band[i]), np.full(len(empty), i)))
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), need
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), need


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by some bits of their hash; a power of two of bits, 3 times the shingles at least."""
    bits = max(64, 1 << (3 * len(shingles) - 1).bit_length())
    odd = np.bincount(((shingles >> _U(8)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(marks: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which sketches a[i] and b[i] differ, the wider folded onto the narrower."""
    words = np.array([len(m) // 8 for m in marks], np.int64)
    at = np.concatenate(([0], np.cumsum(words)))
    flat = np.frombuffer(b"".join(marks), _U)
    out = np.zeros(len(a), np.int64)
    wide, thin = np.where(words[a] >= words[b], a, b), np.where(words[a] >= words[b], b, a)
    kinds = words[wide] * (1 << 32) + words[thin]
    for kind in np.unique(kinds):
        pick = np.flatnonzero(kinds == kind)
        long, short = int(kind) >> 32, int(kind) & 0xFFFFFFFF
        for i in range(0, len(pick), max(1, PAIRS * 8 // long)):
            p = pick[i : i + max(1, PAIRS * 8 // long)]
            x = flat[at[wide[p]][:, None] + np.arange(long)]
            while x.shape[1] > short:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[p] = np.bitwise_count(x ^ flat[at[thin[p]][:, None] + np.arange(short)]).sum(axis=1)
    return out


def folded(mark: bytes) -> bytes:
    """A sketch of a quarter of the bits, 64 at least: it excludes less, and costs less to compare."""
    words = np.frombuffer(mark, _U)
    for _ in range(2):
        if len(words) > 1:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words.tobytes()


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    out = []
    for _, run in kernel.runs(texts):
        out += kernel.shingles(*kernel.words(run), words)
    return out


def _rows(words: int, percent: int):
    def each(batches):
        for b in batches:
            sizes, nodes, needs = [], [], []
            for _, run in kernel.runs(b.column("text")):
                sets = kernel.shingles(*kernel.words(run), words)
                sizes += [len(s) for s in sets]
                nodes += [node(s) for s in sets]
                needs.append(signatures(sets, percent)[2])
            need = np.concatenate(needs) if needs else np.zeros((0, 2), np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *[pa.array(need[:, i]) for i in (0, 1)]], names=["doc_id", "th", "n_shingles", "node", "even", "odd"])

    return each


def _signer(words: int, percent: int):
    def each(batches):
        seen: set[int] = set()  # copies in one task sign once
        for b in batches:
            for _, run in kernel.runs(b.column("text")):
                sets, nodes = [], []
                for s in kernel.shingles(*kernel.words(run), words):
                    x = node(s)
                    if x is not None and x not in seen:
                        seen.add(x)
                        sets.append(s)
                        nodes.append(x)
                signed, who, _ = signatures(sets, percent)
                yield pa.record_batch([pa.array(signed.view(np.int64)), pa.array(np.array(nodes, np.int64)[who])], names=["sig", "node"])

    return each


def _keeper(words: int):
    def each(batches):
        seen: set[int] = set()  # repeated rows of one document meet here
        for b in batches:
            nodes, sets = [], []
            for want, s in zip(b.column("node").to_pylist(), _sets(b.column("text"), words), strict=True):
                if want not in seen:
                    seen.add(want)
                    nodes.append(want)
                    sets.append(s)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), held, pa.array([sketch(s) for s in sets], pa.binary())], names=["node", "n", "held", "mark"])

    return each


def _may(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)


def _groups(batches):
    """(rows, where groups of equal hub, one, two begin and the last ends), of about HELD bytes or one group, from sorted batches."""
    held: list[pa.Table] = []
    size = 0

    def cuts(t):
        cols = [t[c].to_numpy() for c in ("hub", "one", "two")]
        return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        size += b.nbytes
        if size >= HELD:
            t = pa.concat_tables(held)
            at = cuts(t)
            if len(at):
                yield t.slice(0, int(at[-1])), np.concatenate(([0], at))
                t = t.slice(int(at[-1]))
            held, size = [t], t.nbytes
    if held and (t := pa.concat_tables(held)).num_rows:
        at = cuts(t)
        yield t, np.concatenate(([0], at, [t.num_rows]))


def _pairs(bounds: np.ndarray):
    """(a, b) of all rows a < b of one group, in blocks of about PAIRS pairs; groups of equal size at once."""
    sizes = np.diff(bounds)
    for n in np.unique(sizes[sizes > 1]).tolist():
        starts = bounds[:-1][sizes == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, PAIRS // len(i))
        for k in range(0, len(starts), step):
            own = starts[k : k + step, None]
            yield (own + i).ravel(), (own + j).ravel()


def forest(ends: np.ndarray, label: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the edges (ends: 2 x edges) make a spanning forest of the labels of their ends, cheapest first."""
    order = np.argsort(cost, kind="stable")
    label, left, out = label.copy(), order, []
    while True:
        one, two = label[ends[0, left]], label[ends[1, left]]
        left, one, two = left[one != two], one[one != two], two[one != two]
        if not len(left):
            return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
        _, at = np.unique(np.concatenate([np.stack([one, two], 1).ravel()]), return_index=True)  # each label's cheapest edge
        pick = np.unique(at // 2)
        out.append(left[pick])
        names, hook = np.unique(np.concatenate([one[pick], two[pick]]), return_inverse=True)
        root = np.arange(len(names))
        x, y = hook[: len(pick)], hook[len(pick) :]
        while True:
            new = root.copy()
            low = np.minimum(root[x], root[y])
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.minimum(np.searchsorted(names, label), len(names) - 1)
        label = np.where(names[at] == label, names[root[at]], label)


def _finder(percent: int, whole: bool):
    """Pairs of one hub's nodes that are in two components and not excluded by size or sketch: all, or a forest of the likeliest.

    Beside a forest, the hubs (a, b null) of the pairs that it leaves out; each such pair meets again at one of them.
    """

    def each(batches):
        for t, bounds in _groups(batches):
            node_, component, n, chunk, hub = (t[c].to_numpy() for c in ("node", "component", "n", "chunk", "hub"))
            split = t["one"].to_numpy() != t["two"].to_numpy()
            names, at = np.unique(node_, return_inverse=True)
            lead = np.zeros(len(names), np.int64)
            lead[at] = np.arange(len(at))
            marks, sizes, label = t["mark"].take(pa.array(lead)).to_pylist(), n[lead], component[lead]
            small = [folded(m) for m in marks]
            found, costs, places, again = [np.zeros((2, 0), np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _pairs(bounds):
                good = (component[a] != component[b]) & _may(n[a], n[b], percent) & (~split[a] | (chunk[a] != chunk[b]))
                x, y, place = at[a[good]], at[b[good]], hub[a[good]]
                good = differing(small, x, y) <= distance(sizes[x], sizes[y], percent)
                x, y, place = x[good], y[good], place[good]
                both, one = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_index=True)  # once, however many hubs they share here
                x, y, place = both // max(1, len(names)), both % max(1, len(names)), place[one]
                bits, most = differing(marks, x, y), distance(sizes[x], sizes[y], percent)
                good = bits <= most
                ends, cost, place = np.stack([x, y])[:, good], bits[good] / np.maximum(most[good], 1), place[good]
                if not whole:
                    keep = forest(ends, label, cost)
                    again.append(np.unique(np.delete(place, keep)))
                    ends, cost, place = ends[:, keep], cost[keep], place[keep]
                found.append(ends)
                costs.append(cost)
                places.append(place)
            ends, cost, place = np.concatenate(found, axis=1), np.concatenate(costs), np.concatenate(places)
            if not whole:
                keep = forest(ends, label, cost)
                again.append(np.delete(place, keep))
                ends = ends[:, keep]
            left = np.unique(np.concatenate(again))
            none = [None] * len(left)
            a, b = (pa.array([*names[e].tolist(), *none], pa.int64()) for e in ends)
            yield pa.record_batch([a, b, pa.array([*[None] * ends.shape[1], *left.tolist()], pa.int64())], names=["a", "b", "hub"])

    return each


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("held").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("held").alias("hb"))
    same = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(one, "a").join(two, "b").withColumn("same", same).filter(F.col("same") * 100 >= (F.col("na") + F.col("nb") - F.col("same")) * percent).select("a", "b")


def _compare(store: Store, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar pairs, by whole sets of the nodes that are left only."""
    ends = store.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    few = F.broadcast(ends) if ends.count() <= SENT else ends
    held = store.write(sets.select("node", "n", "held").join(few, "node", "left_semi"))
    found = store.write(_verify(pairs, held, percent))
    store.drop(ends, held)
    return found


def _met(store: Store, hubs: DataFrame, joined: DataFrame | None, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """a, b, hub: pairs of nodes of one hub (hub, node) that are in two components, and hubs to look at again; see _finder."""
    by = W.partitionBy("hub")
    if joined is None:
        apart = hubs.withColumn("component", F.col("node"))
    else:
        apart = hubs.join(joined, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    apart = apart.withColumn("least", F.min("component").over(by)).withColumn("most", F.max("component").over(by)).withColumn("parts", F.ceil(F.count(F.lit(1)).over(by) / GROUP).cast("int"))
    apart = apart.filter("least <> most")
    apart = apart.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = store.write(apart.select("hub", "node", "component", "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two")))
    place = ["hub", "one", "two"]
    sent = apart.join(sets.select("node", "n", "mark"), "node").repartition(*place).sortWithinPartitions(*place)
    pairs = store.write(sent.select(*place, "node", "component", "n", "mark", "chunk").mapInArrow(_finder(percent, whole), "a long, b long, hub long").distinct())
    store.drop(apart)
    return pairs


def _rarest(store: Store, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """sig, node, least (the signature's least node): of each node only the signatures by which a similar one finds it.

    A node that shares fewer signatures than it would with a similar one goes. Of m shared ones, at
    least `need` of them with every similar node, the m - need + 1 rarest hold one that is among
    that node's rarest as well (all nodes order signatures alike, by frequency and value).
    """
    by = W.partitionBy("sig")
    ends = [F.min("node").over(by).alias("least"), F.max("node").over(by).alias("most"), F.count(F.lit(1)).over(by).alias("f")]
    met = store.write(signed.select("sig", "node", *ends).filter("least <> most").select("sig", "node", "f").distinct())
    store.release()
    own = W.partitionBy("node", "side")
    met = met.withColumn("side", F.col("sig").bitwiseAND(1)).withColumn("m", F.count(F.lit(1)).over(own)).withColumn("r", F.row_number().over(own.orderBy("f", "sig")))
    met = met.join(nodes.select("node", "even", "odd"), "node").withColumn("need", F.when(F.col("side") == 0, F.col("even")).otherwise(F.col("odd")))
    met = met.filter("m >= need AND r <= m - need + 1").select("sig", "node", *ends[:2]).filter("least <> most")
    return store.write(met.select("sig", "node", "least"))


def link(docs: DataFrame, words: int, percent: int, store: Store) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node, component (its least node), component_id, for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    hashed = docs.withColumn("th", F.xxhash64("text"))
    rows = store.write(hashed.mapInArrow(_rows(words, percent), "doc_id long, th long, n_shingles long, node long, even long, odd long"))
    nodes = store.write(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("one"), F.max("even").alias("even"), F.max("odd").alias("odd")))
    met = _rarest(store, docs.select("text").mapInArrow(_signer(words, percent), "sig long, node long"), nodes)
    store.release()

    hubs = store.write(met.groupBy(F.col("least").alias("hub"), "node").agg(F.count(F.lit(1)).alias("c")))
    store.drop(met)
    wanted = store.write(hubs.select("node").distinct().join(nodes, "node").select("node", F.col("one.doc_id").alias("id"), "one.th"))
    few = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = hashed.join(few, hashed["doc_id"].eqNullSafe(wanted["id"]) & (hashed["th"] == wanted["th"])).select("node", "text")
    sets = store.write(texts.mapInArrow(_keeper(words), "node long, n long, held array<long>, mark binary"))
    store.release()

    best = W.partitionBy("node").orderBy(F.desc("c"), "hub")
    first = hubs.filter("hub <> node").withColumn("r", F.row_number().over(best)).filter("r = 1").select("hub", "node")
    first = first.unionByName(first.select("hub", F.col("hub").alias("node")).distinct())
    hubs_at, hubs, joined, tried = hubs, hubs.select("hub", "node"), None, None
    for turn in range(ROUNDS + 1):
        whole = turn == ROUNDS
        seen = _met(store, hubs if turn else first, joined, sets, percent, whole)
        pairs = seen.filter("a IS NOT NULL").select("a", "b")
        if turn:  # the first round sees a part of each hub only
            hubs = hubs.join(seen.filter("a IS NULL").select("hub"), "hub", "left_semi")
        fresh = pairs if tried is None else store.write(pairs.join(tried, ["a", "b"], "left_anti"))
        got = _compare(store, fresh, sets, percent)
        if joined is None:
            joined = components(store, got)
        elif not got.isEmpty():
            joined = components(store, joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(got))
        tried = fresh if tried is None else store.write(tried.unionByName(fresh))
        store.release()
    store.drop(hubs_at, sets)
    ends = store.write(nodes.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = ends.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ends.join(least, "component").select("node", "component", "component_id")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", "th", "n_shingles", "node", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one of each component: the one with its smallest doc_id.

    Of rows that share that doc_id one stays; rows without words all stay.
    """
    store = Store(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn("id", F.col(f"c{names.index('doc_id')}").cast("long")).withColumn("th", F.xxhash64(F.col(f"c{names.index('text')}").cast("string")))
    found = store.write(link(docs, words, percent, store))
    own = found.filter("node IS NOT NULL")
    keep = own.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("one")).select(F.col("one.doc_id").alias("id"), "one.th", F.lit(True).alias("single"))
    keep = keep.unionByName(found.filter("node IS NULL").select(F.col("doc_id").alias("id"), "th", F.lit(False).alias("single")).distinct())
    keep = store.write(keep.groupBy("id", "th").agg(F.max("single").alias("single")))
    out = plain.join(keep.withColumnRenamed("id", "kept_id").withColumnRenamed("th", "kept_th"), F.col("id").eqNullSafe(F.col("kept_id")) & F.col("th").eqNullSafe(F.col("kept_th")))
    repeated = not own.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    if repeated:
        out = out.filter("single").dropDuplicates(["id", "th"]).unionByName(out.filter("NOT single"))
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), 4, 85, Store(spark)).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.y FROM r JOIN l ON r.c = l.x),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN m ON doc_id = d LEFT JOIN n USING (doc_id)
"""
QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {"op6_jaccard_join": SQL}
