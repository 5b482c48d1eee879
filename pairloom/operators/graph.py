"""Contact graphs: nearest neighbours, radius graphs, neighbourhoods, components, coarsening.

Edges are undirected (a < b, no self-loops, no duplicates) unless a function says directed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: A section of at most so many cells is searched whole, in blocks of rows; larger ones by tiles.
WHOLE = 4000
ROWS = 512


def _nearest(k: int, reach: float | None = None):
    def each(t: pa.Table) -> pa.Table:
        order = np.argsort(t["cell"].to_numpy(), kind="stable")
        cell, x, y = (t[c].to_numpy()[order] for c in ("cell", "x", "y"))
        section = t["section"].to_numpy()[order]
        a, b, d, s, r = [], [], [], [], []
        for at in range(0, len(cell), ROWS):
            dx, dy = x[at : at + ROWS, None] - x[None, :], y[at : at + ROWS, None] - y[None, :]
            dist = np.sqrt(dx * dx + dy * dy)
            dist[np.arange(len(dist)), at + np.arange(len(dist))] = np.inf
            n = min(k, len(cell) - 1)
            pick = np.argsort(dist, axis=1, kind="stable")[:, :n]  # cells are in order, so ties go to the least
            got = np.take_along_axis(dist, pick, 1)
            ok = np.isfinite(got) if reach is None else got <= reach
            i, j = np.nonzero(ok)
            a.append(cell[at + i])
            b.append(cell[pick[i, j]])
            d.append(got[i, j])
            s.append(section[at + i])
            r.append(j + 1)
        cat = [np.concatenate(v) if v else np.zeros(0) for v in (a, b, d, s, r)]
        return pa.table({"a": pa.array(cat[0].astype(np.int64)), "b": pa.array(cat[1].astype(np.int64)), "distance": pa.array(cat[2], pa.float64()), "section": pa.array(cat[3].astype(np.int32)), "rank": pa.array(cat[4].astype(np.int32))})

    return each


SCHEMA = "a long, b long, distance double, section int, rank int"


def _of_tile(most: int):
    """For each place that asks in a tile: the `most` nearest candidates of the 3 x 3 tiles around, and whether none outside may be nearer."""

    def each(t: pa.Table) -> pa.Table:
        order = np.argsort(t["cell"].to_numpy(), kind="stable")
        cell, x, y = (t[c].to_numpy()[order] for c in ("cell", "x", "y"))
        place = np.flatnonzero(t["ask"].to_numpy(zero_copy_only=False)[order])
        section, tx, ty, width, total, x0, y0 = (t[c][0].as_py() for c in ("section", "tx", "ty", "width", "total", "x0", "y0"))
        free = np.minimum.reduce([e for v, o, m in ((x, x0, tx), (y, y0, ty)) for e in (v[place] - o - (m - 1) * width, (m + 2) * width - (v[place] - o))]) - 1e-9 * width
        n = min(most, len(cell))
        near, far, size = [], np.zeros(len(place)), np.zeros(len(place), np.int64)
        rows = max(1, (1 << 21) // max(len(cell), 1))
        for at in range(0, len(place), rows):
            own = place[at : at + rows]
            dx, dy = x[own, None] - x[None, :], y[own, None] - y[None, :]
            dist = np.sqrt(dx * dx + dy * dy)
            i, j = np.nonzero(dist <= np.partition(dist, n - 1, axis=1)[:, n - 1, None])
            d = dist[i, j]
            rank = np.lexsort((j, d, i))  # candidates are in order, so ties go to the least
            i, j, d = i[rank], j[rank], d[rank]
            first = np.searchsorted(i, np.arange(len(own)))
            keep = np.arange(len(i)) - first[i] < n
            near.append((cell[j[keep]], d[keep]))
            far[at : at + rows], size[at : at + rows] = d[first + n - 1], n
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        b, d = (np.concatenate([v[c] for v in near]) if near else np.zeros(0) for c in (0, 1))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, k)) for v, k in ((b.astype(np.int64), pa.int64()), (d, pa.float64()))]
        settled = (n >= total) | ((n >= most) & (far < free))
        return pa.table({"section": pa.array(np.full(len(place), section), pa.int32()), "x": x[place], "y": y[place], "b": lists[0], "distance": lists[1], "settled": pa.array(np.broadcast_to(settled, len(place)))})

    return each


#: Candidates of a tile, on average.
TILE = 64


def knn(cells: DataFrame, k: int, whole: int = WHOLE) -> DataFrame:
    """Directed: a, b, distance, section, rank (from 1) of each cell's k nearest in its section; ties to the least id.

    Sections up to `whole` cells are one Arrow group each. In larger ones places ask instead of cells, and
    only the k + 1 least cells of a place are candidates: no cell can have another one of it as a neighbour, however many
    share the place. Places meet the candidates of the 3 x 3 tiles around them, a tile an Arrow group; one whose
    k + 1st candidate may lie outside meets wider tiles in the next round, until all are settled. A cell's neighbours
    are its place's but itself. Non-finite coordinates have no neighbours.
    """
    cells = cells.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("section").cast("int").alias("section"))
    sizes = cells.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > whole).select("section"))
    if large.isEmpty():
        return cells.groupBy("section").applyInArrow(_nearest(k), SCHEMA)
    out = cells.join(sizes.filter(F.col("n") <= whole).select("section"), "section", "left_semi").select("cell", "x", "y", "section").groupBy("section").applyInArrow(_nearest(k), SCHEMA)
    most = k + 1
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    points = cells.join(large, "section", "left_semi").filter(finite).select("cell", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), "section")  # -0.0 is 0.0
    first = F.row_number().over(W.partitionBy("section", "x", "y").orderBy("cell"))
    held = cut(points.withColumn("r", first).filter(F.col("r") <= most))
    box = held.groupBy("section").agg(F.count(F.lit(1)).alias("total"), *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    across, up = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = F.greatest(F.sqrt(F.greatest(across * up, F.lit(1e-12)) * max(TILE, 2 * most) / F.col("total")), across / 1e4, up / 1e4, F.lit(1e-9))
    held = held.join(box.select("section", "total", "x0", "y0", side.alias("side")), "section")
    asking, lists = None, None
    for turn in range(40):
        width = F.col("side") * float(2**turn)
        placed = held.select("*", width.alias("width"), *[F.floor((F.col(c) - F.col(f"{c}0")) / width).alias(f"m{c}") for c in "xy"])
        asks = F.col("r") == 1
        if asking is not None:
            placed = placed.join(asking, ["section", "x", "y"], "left")
            asks = asks & F.coalesce("unsettled", F.lit(False))
        placed = placed.withColumn("asks", asks)
        near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        spread = placed.withColumn("ox", F.explode(near)).withColumn("oy", F.explode(near))
        spread = spread.select("section", "cell", "x", "y", "x0", "y0", "total", "width", (F.col("asks") & (F.col("ox") == 0) & (F.col("oy") == 0)).alias("ask"), (F.col("mx") + F.col("ox")).alias("tx"), (F.col("my") + F.col("oy")).alias("ty"))
        if asking is not None:
            tiles = placed.filter("asks").select("section", F.col("mx").alias("tx"), F.col("my").alias("ty")).distinct()
            spread = spread.join(tiles, ["section", "tx", "ty"], "left_semi")
        met = cut(spread.groupBy("section", "tx", "ty").applyInArrow(_of_tile(most), "section int, x double, y double, b array<long>, distance array<double>, settled boolean"))
        done = met.filter("settled").drop("settled")
        lists = done if lists is None else lists.unionByName(done)
        asking = met.filter("NOT settled").select("section", "x", "y", F.lit(True).alias("unsettled"))
        if asking.isEmpty():
            break
    else:
        raise ValueError("coordinates are too far apart for tiles")
    others = F.slice(F.filter(F.arrays_zip("b", "distance"), lambda e: e["b"] != F.col("cell")), 1, k)
    got = points.join(lists, ["section", "x", "y"]).select("cell", "section", F.posexplode(others).alias("at", "e"))
    return out.unionByName(got.select(F.col("cell").alias("a"), "e.b", "e.distance", "section", (F.col("at") + 1).cast("int").alias("rank")))


def radius(cells: DataFrame, reach: float, most: int) -> DataFrame:
    """Directed: neighbours within reach, the nearest `most` of them; a tile of that width bounds the search."""
    near = knn(cells, most)
    return near.filter(F.col("distance") <= reach)


def undirected(directed: DataFrame) -> DataFrame:
    """a < b, distance, section: each contact once, whichever end named it."""
    return directed.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance"), F.min("section").alias("section"))


def reciprocal(directed: DataFrame) -> DataFrame:
    """Only contacts that both ends name."""
    ends = directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance"))
    return ends.filter("n = 2").drop("n")


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst: every contact from both ends."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """a, b, cell and the columns keep: one row for each end."""
    return edges.select("a", "b", *keep, F.explode(F.array("a", "b")).alias("cell"))


def _met(edges: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """a, b, the columns keep, feature, l, r: a row for each count of either end.

    A cell's counts travel as one list, to a contact's a and then to its b; the rows come out dealt by b, so that sums by
    contact need no further shuffle.
    """
    own = counts.groupBy("cell").agg(F.collect_list(F.struct("feature", "count")).alias("own"))
    met = edges.select("a", "b", *keep)
    for c in ("a", "b"):
        met = met.join(own.select(F.col("cell").alias(c), F.col("own").alias(f"of_{c}")), c, "left")
    zero = F.lit(0.0)
    left = F.transform("of_a", lambda x: F.struct(x["feature"].alias("feature"), x["count"].cast("double").alias("l"), zero.alias("r")))
    right = F.transform("of_b", lambda x: F.struct(x["feature"].alias("feature"), zero.alias("l"), x["count"].cast("double").alias("r")))
    both = F.flatten(F.filter(F.array(left, right), lambda x: x.isNotNull()))
    return met.select("a", "b", *keep, F.explode(both).alias("x")).select("a", "b", *keep, "x.feature", "x.l", "x.r")


def pool_endpoints(edges: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """a, b, the columns keep (fixed by a and b), feature, count: the sum over both ends."""
    return _met(edges, counts, *keep).groupBy("a", "b", *keep, "feature").agg(F.sum(F.col("l") + F.col("r")).alias("count"))


def most_counted(edges: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """a, b, the columns keep, feature: the one with the largest sum over both ends, ties to the last; contacts without counts are left out.

    A cell's counts travel as one map, and a contact's two maps are added within its row.
    """
    name = F.coalesce("feature", F.lit(""))  # a map has no null key
    own = counts.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("count").cast("double")))).alias("own"))
    met = edges.select("a", "b", *keep)
    for c in ("a", "b"):
        met = met.join(own.select(F.col("cell").alias(c), F.col("own").alias(f"of_{c}")), c, "left")
    both = F.map_zip_with("of_a", "of_b", lambda _, l, r: F.coalesce(l + r, l, r))
    entries = F.map_entries(F.coalesce(both, "of_a", "of_b"))
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("count"), e["key"].alias("feature"))))
    return met.withColumn("best", best).filter("best IS NOT NULL").select("a", "b", *keep, F.nullif("best.feature", F.lit("")).alias("feature"))


def shared_difference(edges: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """a, b, the columns keep (fixed by a and b), feature, shared (l + r), difference (|l - r|) for features that either end has."""
    left, right = F.sum("l"), F.sum("r")
    return _met(edges, counts, *keep).groupBy("a", "b", *keep, "feature").agg((left + right).alias("shared"), F.abs(left - right).alias("difference"))


def neighbour_sum(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """src, total, mean, degree over contacts; a neighbour without a value counts as 0."""
    met = both_ways(edges).join(values.select(F.col("cell").alias("dst"), F.col(value).alias("v")), "dst", "left")
    total = F.sum(F.coalesce("v", F.lit(0.0)))
    return met.groupBy("src").agg(total.alias("total"), (total / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("degree"))


#: Members of a class that one row meets when pairs of classes become pairs of cells, on average.
MEMBERS = 1024


def classes(ends: DataFrame) -> DataFrame:
    """src, class: cells with the very same contacts share a class, the least of them. ends: src, dst from both ends."""
    near = ends.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near"))
    return near.select("src", F.min("src").over(W.partitionBy("near")).alias("class"))


def second_neighbours(edges: DataFrame) -> DataFrame:
    """src, dst: contacts of contacts that are neither the cell nor its contacts.

    Cells with the same contacts have the same second neighbours, are not in contact and touch another such class wholly or not at
    all. So pairs of classes are found and made distinct first; they become pairs of cells last, in joins whose rows stay where they are made.
    """
    ends = cut(both_ways(edges))
    of = cut(classes(ends))
    first = ends.join(of.filter("src = class").select("src"), "src", "left_semi")
    links = cut(first.join(of.select(F.col("src").alias("dst"), F.col("class").alias("to")), "dst").select(F.col("src").alias("class"), "to").distinct())
    two = links.join(links.select(F.col("class").alias("to"), F.col("to").alias("far")), "to").select("class", F.col("far").alias("to")).distinct()
    two = two.join(links, ["class", "to"], "left_anti")
    slots = of.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("slots"))
    members = of.join(slots, "class").select(F.col("class").alias("to"), F.col("src").alias("dst"), F.pmod(F.xxhash64("src"), F.col("slots")).cast("int").alias("slot"))
    asked = two.join(slots.withColumnRenamed("class", "to"), "to").select("class", "to", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    return of.join(asked, "class").join(members, ["to", "slot"]).select("src", "dst").filter("src <> dst")


def unite(edges: DataFrame, more: DataFrame) -> DataFrame:
    """a, b, edge_kind (0 of the first, 1 only of the second), weight: the rank of the distance within its kind."""
    extra = more.join(edges, ["a", "b"], "left_anti")
    both = edges.select("a", "b", "distance", F.lit(0).alias("edge_kind")).unionByName(extra.select("a", "b", "distance", F.lit(1).alias("edge_kind")))
    return both.withColumn("weight", F.percent_rank().over(W.partitionBy("edge_kind").orderBy("distance")))


def super_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, n: contacts between groups (cell, group); those inside a group are dropped."""
    one = groups.select(F.col("cell").alias("a"), F.col("group").alias("ga"))
    two = groups.select(F.col("cell").alias("b"), F.col("group").alias("gb"))
    met = edges.join(one, "a").join(two, "b").filter("ga <> gb")
    return met.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Contacts whose two ends are both in keep (cell)."""
    return edges.join(keep.select(F.col("cell").alias("a")), "a", "left_semi").join(keep.select(F.col("cell").alias("b")), "b", "left_semi")


def components(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, component: the least cell reachable. Large-star and small-star joins, a checkpoint each round."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = cut(large.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
    return cells.select("cell").join(now.select(F.col("a").alias("cell"), F.col("b").alias("component")), "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The contacts left when cells with fewer than k contacts are taken away until none is left."""
    now = cut(edges.select("a", "b"))
    size = now.count()
    while True:
        degree = endpoints(now).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        now = cut(induced(now, degree))
        left = now.count()
        if left == size:
            return now
        size = left


def shared_neighbours(edges: DataFrame, least: int) -> DataFrame:
    """a, b, shared: pairs of cells with at least `least` common contacts."""
    ends = both_ways(edges)
    met = ends.select("dst", F.col("src").alias("a")).join(ends.select("dst", F.col("src").alias("b")), "dst").filter("a < b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def bounded(edges: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Groups (cell, group) of more than k cells, for searches within them."""
    return groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k), "group", "left_semi")


def majority(labels: DataFrame, by: str, label: Column) -> DataFrame:
    """by, label: the commonest label, ties to the least."""
    n = labels.groupBy(by, label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "label"))).filter("r = 1").select(by, "label")
