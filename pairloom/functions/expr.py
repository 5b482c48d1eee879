"""Column builders: normalisation, robust statistics on arrays, tests of proportions, decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def log_cp10k(x: Column, total: Column) -> Column:
    """ln(1 + 10000 x / total); an empty unit gives 0."""
    return F.when(total > 0, F.log1p(x * 1e4 / total)).otherwise(0.0)


def x_ln_x(x: Column) -> Column:
    """x ln x, continued by 0 at 0."""
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2.0


def quantile_nearest(values: Column, q: float) -> Column:
    """The element of rank round(q (n - 1)) of an array; null for an empty one."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, F.element_at(s, (F.floor((n - 1) * q + 0.5) + 1).cast("int")))


def upper_median(values: Column) -> Column:
    """The element of rank n / 2 (from 0) of an array."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, F.element_at(s, (F.floor(n / 2) + 1).cast("int")))


def divide_batch(x: Column, delta: Column) -> Column:
    """x / delta; a fold that is missing or not positive leaves x."""
    return F.when(delta > 0, x / delta).otherwise(x)


def classify_contact(l_a: Column, r_a: Column, l_b: Column, r_b: Column) -> Column:
    """Which way a contact can signal, from what either end detects: mutual, oneway or silent."""
    forth, back = l_a & r_b, l_b & r_a
    return F.when(forth & back, "mutual").when(forth | back, "oneway").otherwise("silent")


def jeffreys_log_odds(n11: Column, n_l: Column, n_r: Column, n: Column) -> tuple[Column, Column]:
    """(log odds ratio, standard error) of a table counted from both ends of each contact.

    Half a contact is added to every cell. NaN where only the prior speaks: no joint detection and
    fewer than half an expected one. The variance is doubled, since a contact is counted twice.
    """
    a, b, c = n11 + 0.5, n_l - n11 + 0.5, n_r - n11 + 0.5
    d = n - n_l - n_r + n11 + 0.5
    prior = (n11 == 0) & (2 * n_l * n_r < n)
    value = F.log(a) + F.log(d) - F.log(b) - F.log(c)
    se = F.sqrt(2.0 * (1 / a + 1 / b + 1 / c + 1 / d))
    return F.when(prior | (n == 0), nan()).otherwise(value), F.when(prior | (n == 0), nan()).otherwise(se)


def symbol(name: Column) -> Column:
    """The gene symbol behind an Ensembl id and "_"; other names stay."""
    return F.when(name.rlike(r"^ENS[A-Z]*G[0-9]+(\.[0-9]+)?_.+"), F.regexp_extract(name, r"^ENS[A-Z]*G[0-9]+(?:\.[0-9]+)?_(.+)$", 1)).otherwise(name)


def section_of(cell: Column) -> Column:
    """The text after the last @ of a cell's name; empty without one."""
    return F.when(cell.contains("@"), F.substring_index(cell, "@", -1)).otherwise("")


def section_matches(section: Column, name: Column) -> Column:
    """Equal, or ending in "_" and the name."""
    return (section == name) | F.endswith(section, F.concat(F.lit("_"), name))


def file_stem(path: Column) -> Column:
    """The file's name without folders, zip and one more suffix."""
    base = F.substring_index(path, "/", -1)
    return F.regexp_replace(F.regexp_replace(base, r"\.zip$", ""), r"\.[^.]+$", "")


def canonical_pair(text: Column) -> Column:
    """A complex's subunits in upper case and alphabetical order, joined by "_"."""
    return F.array_join(F.array_sort(F.split(F.upper(F.trim(text)), "_")), "_")


def is_none_label(label: Column) -> Column:
    return label.isNull() | F.lower(F.trim(label)).isin("", "na", "-1", "unassigned")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from md5, so that other engines can draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def unit_row(v: Column) -> Column:
    """An array of doubles scaled to length one; a zero row stays zero."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def in_rings(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd test of a point against closed rings (an outer one and holes alike)."""
    crossings = F.lit(0)
    for ring in rings:
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if yi != yj:
                crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
                crossings = crossings + F.when(crosses, 1).otherwise(0)
    return crossings % 2 == 1


def verdict(estimable: Column, confounded: Column, control_failed: Column, coexpressed: Column, effect: Column) -> Column:
    """A pair's verdict from five facts, in a fixed order of precedence."""
    return (
        F.when(~estimable, "insufficient_data")
        .when(confounded, "celltype_inseparable")
        .when(control_failed & effect, "control_failed")
        .when(coexpressed & effect, "supported")
        .when(coexpressed, "colocation_only")
        .when(effect, "effect_without_coexpression")
        .otherwise("no_evidence")
    )
