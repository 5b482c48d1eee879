"""Spatial autocorrelation with delete-one-tile standard errors, and features' shares of signal from them.

Moran's I is pooled over sections, each centred on its own mean. A replicate leaves out the cells of one tile and
the contacts that touch it. All replicates come from sums by (section, tile, feature) of the sparse values: a cell's
value counts in a contact sum of its own tile as often as it has contacts, and in another tile's as often as
it has contacts there. A feature without values in a section has zeros there: then only cells
and contacts change, the same for all such features, and these replicates enter as two sums by section.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pool import collected

#: Features whose statistics the driver holds.
FEATURES = 1_000_000


def tiled(cells: DataFrame, tiles: int) -> DataFrame:
    """cell, section, tile: each section's bounding box in tiles x tiles."""
    box = cells.groupBy("section").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    place = [F.least(F.floor((F.col(c) - F.col(f"low{c}")) / F.greatest(F.col(f"high{c}") - F.col(f"low{c}"), F.lit(1e-12)) * tiles), F.lit(tiles - 1)) for c in "xy"]
    return cells.join(box, "section").select("cell", "section", (place[0] * tiles + place[1]).cast("int").alias("tile"))


def _centred(n: Column, s: Column, ss: Column, w: Column, xy: Column, x: Column) -> tuple[Column, Column]:
    mean = F.when(n > 0, s / n).otherwise(0.0)
    return xy - mean * x + w * mean * mean, ss - 2 * mean * s + n * mean * mean


def replicates(edges: DataFrame, cells: DataFrame, values: DataFrame, tiles: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(section, tile, n, w: of each tile; section, feature, num, den: of each section in which the feature has values;
    section, tile, feature, num, den: changes when the tile is left out). edges: a, b; cells: cell, section, x, y; values: cell, feature, value."""
    at = cut(tiled(cells, tiles))
    values = values.filter("value <> 0").select("cell", F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("v"))
    one, two = (at.select(F.col("cell").alias(c), F.col("section").alias(f"s{c}"), F.col("tile").alias(f"t{c}")) for c in "ab")
    ends = cut(edges.select("a", "b").filter("a <> b").join(one, "a").join(two, "b").filter("sa = sb").select("a", "b", F.col("sa").alias("section"), "ta", "tb"))
    touched = ends.select("section", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile")).groupBy("section", "tile").agg(F.count(F.lit(1)).alias("w"))
    sizes = cut(at.groupBy("section", "tile").agg(F.count(F.lit(1)).alias("n")).join(touched, ["section", "tile"], "left").na.fill(0, ["w"]))
    sections = sizes.groupBy("section").agg(F.sum("n").alias("all_n")).join(ends.groupBy("section").agg(F.count(F.lit(1)).alias("all_w")), "section", "left").na.fill(0, ["all_w"])
    sided = ends.select(F.col("a").alias("cell"), F.col("ta").alias("own"), F.col("tb").alias("far")).unionByName(ends.select(F.col("b").alias("cell"), F.col("tb").alias("own"), F.col("ta").alias("far")))
    reach = sided.select("cell", F.explode(F.array_distinct(F.array("own", "far"))).alias("tile")).groupBy("cell", "tile").agg(F.count(F.lit(1)).alias("c"))
    placed = cut(values.join(at, "cell"))
    own = placed.groupBy("section", "tile", "feature").agg(F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("ss"))
    x = placed.select("cell", "section", "feature", "v").join(reach, "cell").groupBy("section", "tile", "feature").agg(F.sum(F.col("v") * F.col("c")).alias("x"))
    left, right = (values.select(F.col("cell").alias(c), "feature", F.col("v").alias(f"v{c}")) for c in "ab")
    cross = cut(ends.join(left, "a").join(right, ["b", "feature"]).groupBy("section", "ta", "tb", "feature").agg(F.sum(F.col("va") * F.col("vb")).alias("xy")))
    xy = cross.select("section", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"), "feature", "xy").groupBy("section", "tile", "feature").agg(F.sum("xy").alias("xy"))
    key = ["section", "tile", "feature"]
    part = cut(own.join(x, key, "full").join(xy, key, "full").na.fill(0.0, ["s", "ss", "x", "xy"]))
    degree = sided.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    whole = placed.join(degree, "cell", "left").groupBy("section", "feature").agg(F.sum("v").alias("all_s"), F.sum(F.col("v") ** 2).alias("all_ss"), F.sum(F.col("v") * F.coalesce("c", F.lit(0))).alias("all_x"))
    whole = whole.join(cross.groupBy("section", "feature").agg(F.sum("xy").alias("all_xy")), ["section", "feature"], "left").na.fill(0.0, ["all_xy"]).join(sections, "section")
    num, den = _centred(*map(F.col, ("all_n", "all_s", "all_ss", "all_w", "all_xy", "all_x")))
    whole = cut(whole.withColumn("num", num).withColumn("den", den))
    spread = whole.join(sizes, "section").join(part, key, "left").na.fill(0.0, ["s", "ss", "x", "xy"])
    less = [F.col(a) - F.col(b) for a, b in (("all_n", "n"), ("all_s", "s"), ("all_ss", "ss"), ("all_w", "w"), ("all_xy", "xy"), ("all_x", "x"))]
    n2, d2 = _centred(*less)
    changes = spread.select(*key, "n", "w", (n2 - F.col("num")).alias("num"), (d2 - F.col("den")).alias("den"))
    return sizes, whole.select("section", "feature", "num", "den"), changes


def moran(edges: DataFrame, cells: DataFrame, values: DataFrame, tiles: int = 4) -> DataFrame:
    """feature, moran, se, t = (moran + 1 / (N - 1)) / se; zeros for features without variance or contacts."""
    sizes, sections, changes = replicates(edges, cells, values, tiles)
    n = sizes.agg(F.sum("n")).first()[0] or 0
    w = edges.filter("a <> b").select("a", "b").join(cells.select(F.col("cell").alias("a"), F.col("section").alias("sa")), "a").join(cells.select(F.col("cell").alias("b"), F.col("section").alias("sb")), "b").filter("sa = sb").count()
    total = sections.groupBy("feature").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    if not w or n < 2:
        return total.select("feature", *[F.lit(0.0).alias(c) for c in ("moran", "se", "t")])
    total = total.withColumn("moran", F.when(F.col("den") > 0, n / w * F.col("num") / F.col("den")))
    # replicates as differences from the whole, so that their spread loses no digits
    met = changes.withColumnsRenamed({"num": "dnum", "den": "dden"}).join(total, "feature")
    num, den = F.col("num") + F.col("dnum"), F.col("den") + F.col("dden")
    d = F.when((den > 0) & (F.lit(w) > F.col("w")), (n - F.col("n")) / (w - F.col("w")) * num / den - F.col("moran"))
    shown = met.groupBy("feature").agg(F.count(d).alias("g1"), F.sum(d).alias("d1"), F.sum(d * d).alias("q1"))
    ratio = F.when(F.lit(w) > F.col("w"), (n - F.col("n")) / (w - F.col("w")) - n / w)
    by = sizes.groupBy("section").agg(F.count(ratio).alias("g"), F.coalesce(F.sum(ratio), F.lit(0.0)).alias("r"), F.coalesce(F.sum(ratio * ratio), F.lit(0.0)).alias("rr"))
    every = by.agg(*[F.sum(c).alias(c) for c in ("g", "r", "rr")]).first()
    present = sections.join(by, "section").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("g", "r", "rr")])
    out = total.join(shown, "feature").join(present, "feature")
    c = F.col("num") / F.col("den")
    g = F.col("g1") + every["g"] - F.col("g")
    s1 = F.coalesce("d1", F.lit(0.0)) + c * (every["r"] - F.col("r"))
    s2 = F.coalesce("q1", F.lit(0.0)) + c * c * (every["rr"] - F.col("rr"))
    se = F.when((g > 1) & F.col("moran").isNotNull(), F.sqrt(F.greatest((g - 1) / g * (s2 - s1 * s1 / g), F.lit(0.0)))).otherwise(0.0)
    out = out.select("feature", F.coalesce("moran", F.lit(0.0)).alias("moran"), se.alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, (F.col("moran") + 1 / max(n - 1, 1)) / F.col("se")).otherwise(0.0))


def shares(t: np.ndarray) -> tuple[np.ndarray, float]:
    """(1 - local false discovery rate of each t, the null's share) from two groups: the null is normal with the
    median and the median deviation of all t, the mixture a Gaussian kernel estimate; one-sided, never falling in t."""
    n = len(t)
    if n < 3:
        return np.ones(n), 0.0
    s = np.sort(t)
    at = lambda q: s[int(math.floor(q * (n - 1) + 0.5))]
    centre = at(0.5)
    scale = 1.4826 * np.sort(np.abs(t - centre))[n // 2]
    if scale <= 0:
        return np.ones(n), 0.0
    null = min(float((np.abs(t - centre) < scale).mean()) / math.erf(math.sqrt(0.5)), 1.0)
    iqr = (at(0.75) - at(0.25)) / 1.34
    sd = float(np.std(t, ddof=1))
    width = 0.9 * max(min(sd, iqr) if iqr > 0 else sd, 1e-12) * n**-0.2
    low, high = max(s[0], centre - 40 * scale) - 4 * width, min(s[-1], centre + 40 * scale) + 4 * width
    points = int(min(max(math.ceil((high - low) / (width / 4)) + 1, 2), 1 << 16))
    step = (high - low) / (points - 1)
    bins = np.clip(np.round((t - low) / step), 0, points - 1).astype(np.int64)
    near = np.arange(-math.ceil(4 * width / step), math.ceil(4 * width / step) + 1)
    kernel = np.exp(-0.5 * (near * step / width) ** 2)
    density = np.convolve(np.bincount(bins, minlength=points), kernel / (n * step * kernel.sum()), "same" if points >= len(kernel) else "full")
    if points < len(kernel):
        density = density[len(near) // 2 :][:points]
    f0 = np.exp(-0.5 * ((t - centre) / scale) ** 2) / (scale * math.sqrt(2 * math.pi))
    raw = np.where(t <= centre, 0.0, 1 - np.clip(null * f0 / np.maximum(density[bins], 1e-300), 0, 1))
    order = np.argsort(t, kind="stable")
    out = np.empty(n)
    out[order] = np.maximum.accumulate(raw[order])
    return out, null


def inclusion(scored: DataFrame) -> DataFrame:
    """feature, t, inclusion of features (feature, t): one number a feature, at most FEATURES of them, goes through the driver."""
    rows = sorted(collected(scored.select("feature", "t"), FEATURES), key=lambda r: (r["t"], r["feature"]))
    pi, _ = shares(np.array([r["t"] for r in rows], float))
    return scored.sparkSession.createDataFrame([(r["feature"], r["t"], float(p)) for r, p in zip(rows, pi, strict=True)], "feature string, t double, inclusion double")
