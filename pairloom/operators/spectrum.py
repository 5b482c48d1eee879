"""Spectra of graph Laplacians by section, and linear systems in them.

A matrix is held as links (src, dst, w) with its diagonal among them, so one join and one groupBy give
the product with several vectors at once (a column each) and carry their rows along. Iterations keep
their vectors in a table; what reaches the driver are inner products by section and column.

Small sections take their exact eigenvalues in one Arrow group each. Larger ones take stochastic Lanczos
quadrature (sections of at most WHOLE entries with all steps in one Arrow group, others a pass over the links a step): from seeded Rademacher probes a tridiagonal matrix each, whose eigenvalues are the nodes and
whose eigenvectors' first entries give the weights. sum over (weight * f(theta)) estimates the trace of f(L).
The constant vector, whose eigenvalue is 0, is taken out of the probes and is a node of its own, so
that the traces of functions that are large at 0 vary less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Sections whose sums may be held on the driver.
SECTIONS = 100_000
#: Entries of a section whose Lanczos steps run in one group.
WHOLE = 1 << 22
#: Cells times columns of a section whose linear systems are solved in one group.
NUMBERS = 1 << 23
#: A residual of less than this share of the product ends a Lanczos recurrence.
TINY = 1e-9


def links(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """section, src, dst, w of L = D - W, diagonal included. cells: cell, section; edges: a, b, weight; loops count for nothing."""
    off = edges.filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    both = off.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(off.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    named = cells.select("section", F.col("cell").alias("src"))
    degree = named.join(both.groupBy("src").agg(F.sum("weight").alias("w")), "src", "left").select("section", "src", F.col("src").alias("dst"), F.coalesce("w", F.lit(0.0)).alias("w"))
    return degree.unionByName(named.join(both, "src").select("section", "src", "dst", (-F.col("weight")).alias("w")))


def product(matrix: DataFrame, vectors: DataFrame, of: list[str], to: list[str], keep: list[str] | tuple = ()) -> DataFrame:
    """section, cell, the products `to` of the columns `of`, and the columns of and keep as they are. vectors: cell and these columns."""
    carried = [*of, *keep]
    met = matrix.join(vectors.select(F.col("cell").alias("dst"), *carried), "dst")
    own = [F.max(F.when(F.col("src") == F.col("dst"), F.col(c))).alias(c) for c in carried]
    return met.groupBy("section", F.col("src").alias("cell")).agg(*[F.sum(F.col("w") * F.col(c)).alias(t) for c, t in zip(of, to, strict=True)], *own)


def sums(rows: DataFrame, **terms: Column) -> dict[int, dict[str, float]]:
    """By section, the sums of the terms."""
    got = rows.groupBy("section").agg(*[F.sum(c).alias(name) for name, c in terms.items()]).limit(SECTIONS + 1).toArrow()
    if got.num_rows > SECTIONS:
        raise ValueError(f"more than {SECTIONS} sections")
    return {r.pop("section"): r for r in got.to_pylist()}


def scaled(rows: DataFrame, by: dict[int, dict[str, float]]) -> DataFrame:
    """rows with the numbers of their section (at most SECTIONS rows of them, broadcast)."""
    names = list(next(iter(by.values())))
    table = pa.table({"section": pa.array(list(by), pa.int64()), **{c: pa.array([v[c] for v in by.values()], pa.float64()) for c in names}})
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table).withColumn("section", F.col("section").cast(rows.schema["section"].dataType))), "section")


def _quadrature(alpha: list[float], beta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the tridiagonal matrix, and the squared first entries of its eigenvectors."""
    m = len(alpha)
    t = np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return np.maximum(values, 0.0), vectors[0] ** 2


def lanczos(matrix: DataFrame, probes: int, steps: int, seed: int = 0) -> DataFrame:
    """section, theta, weight: nodes whose weights sum to the section's cells; probes x steps of them at most.

    Traces of smooth functions agree between reruns but for rounding; single nodes of the last steps need not.
    matrix: see links(). A step is one pass over the links and one sum by section.
    """
    spark = matrix.sparkSession
    matrix = cut(matrix)
    v, u, w = ([f"{c}{p}" for p in range(probes)] for c in "vuw")
    cells = matrix.filter("src = dst").select("section", F.col("src").alias("cell"))
    size = sums(cells, n=F.lit(1))
    if not size:
        return spark.createDataFrame([], "section int, theta double, weight double")
    signs = {f"s{p}": F.when(F.xxhash64("cell", F.lit(seed), F.lit(p)).bitwiseAND(1) == 0, 1.0).otherwise(-1.0) for p in range(probes)}
    mean = {s: {f"s{p}": d[f"s{p}"] / size[s]["n"] for p in range(probes)} for s, d in sums(cells, **signs).items()}
    length = {s: {p: size[s]["n"] * (1 - m[f"s{p}"] ** 2) for p in range(probes)} for s, m in mean.items()}
    start = scaled(cells, {s: {f"m{p}": m[f"s{p}"] for p in range(probes)} | {f"i{p}": 1 / np.sqrt(length[s][p]) if length[s][p] > 0.5 else 0.0 for p in range(probes)} for s, m in mean.items()})
    now = start.select("cell", *[((signs[f"s{p}"] - F.col(f"m{p}")) * F.col(f"i{p}")).alias(c) for p, c in enumerate(v)], *[F.lit(0.0).alias(c) for c in u])
    alpha = {s: [[] for _ in range(probes)] for s in size}
    beta = {s: [[] for _ in range(probes)] for s in size}
    over = {s: [False] * probes for s in size}
    for step in range(steps):
        got = cut(product(matrix, now, v, w, u))
        dots = {f"{x}{y}{p}": F.col(f"{x}{p}") * F.col(f"{y}{p}") for p in range(probes) for x, y in ("ww", "wv", "wu", "vv", "vu", "uu")}
        by = sums(got, **dots)
        use = {}
        for s, d in by.items():
            use[s] = {}
            for p in range(probes):
                a, b = d[f"wv{p}"], beta[s][p][-1] if beta[s][p] else 0.0
                left = d[f"ww{p}"] - 2 * a * d[f"wv{p}"] - 2 * b * d[f"wu{p}"] + a * a * d[f"vv{p}"] + b * b * d[f"uu{p}"] + 2 * a * b * d[f"vu{p}"]
                if not over[s][p]:
                    alpha[s][p].append(a)
                    over[s][p] = left <= TINY * max(d[f"ww{p}"], 1e-300) or step + 1 >= size[s]["n"]
                    if not over[s][p]:
                        beta[s][p].append(float(np.sqrt(left)))
                use[s] |= {f"a{p}": a, f"b{p}": b, f"i{p}": 0.0 if over[s][p] else 1 / beta[s][p][-1]}
        if all(all(o) for o in over.values()):
            break
        held = scaled(got, use)
        new = [((F.col(f"w{p}") - F.col(f"a{p}") * F.col(f"v{p}") - F.col(f"b{p}") * F.col(f"u{p}")) * F.col(f"i{p}")).alias(f"v{p}") for p in range(probes)]
        now = held.select("cell", *new, *[F.col(f"v{p}").alias(f"u{p}") for p in range(probes)])
    rows = []
    for s, r in size.items():
        live = [p for p in range(probes) if length[s][p] > 0.5]
        rows.append((s, 0.0, 1.0 if live else float(r["n"])))
        for p in live:
            theta, weight = _quadrature(alpha[s][p], beta[s][p])
            rows += [(s, float(t), float(x) * (r["n"] - 1) / len(live)) for t, x in zip(theta, weight, strict=True)]
    return spark.createDataFrame(rows, "section int, theta double, weight double")


def exact(matrix: DataFrame) -> DataFrame:
    """section, theta, weight (1): all eigenvalues, each section a dense matrix in one group (for small sections)."""

    def each(t: pa.Table) -> pa.Table:
        src, dst, w = (t[c].to_numpy() for c in ("src", "dst", "w"))
        names = np.unique(src)
        dense = np.zeros((len(names), len(names)))
        np.add.at(dense, (np.searchsorted(names, src), np.searchsorted(names, dst)), w)
        values = np.maximum(np.linalg.eigvalsh(dense), 0.0)
        return pa.table({"section": pa.array(np.full(len(values), t["section"][0].as_py()), pa.int32()), "theta": values, "weight": np.ones(len(values))})

    return matrix.select(F.col("section").cast("int").alias("section"), "src", "dst", "w").groupBy("section").applyInArrow(each, "section int, theta double, weight double")


def moments(matrix: DataFrame) -> DataFrame:
    """section, n, first, second: the sums of all eigenvalues and of their squares, which are the traces of L and L^2: sums over entries, whatever a section's size."""
    entries = matrix.groupBy("section", "src", "dst").agg(F.sum("w").alias("w"))
    diagonal = F.col("src") == F.col("dst")
    return entries.groupBy("section").agg(F.count(F.when(diagonal, 1)).alias("n"), F.sum(F.when(diagonal, F.col("w"))).alias("first"), F.sum(F.col("w") * F.col("w")).alias("second"))


def _recurrence(names: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, sign: np.ndarray, steps: int) -> tuple[list[float], list[float]]:
    """The tridiagonal matrix of one probe; see lanczos()."""
    n = len(names)
    v, u = sign - sign.mean(), np.zeros(n)
    alpha: list[float] = []
    beta: list[float] = []
    length = n * (1 - sign.mean() ** 2)
    v *= 1 / np.sqrt(length) if length > 0.5 else 0.0
    for step in range(steps):
        x = np.bincount(src, weights=w * v[dst], minlength=n)
        a, size = float(x @ v), float(x @ x)
        x -= a * v + (beta[-1] if beta else 0.0) * u
        left = float(x @ x)
        alpha.append(a)
        if left <= TINY * max(size, 1e-300) or step + 1 >= n:
            break
        beta.append(float(np.sqrt(left)))
        v, u = x / beta[-1], v
    return alpha, beta


def lanczos_by_section(matrix: DataFrame, probes: int, steps: int, seed: int = 0) -> DataFrame:
    """The nodes of lanczos() with the same probes; each section's matrix and three vectors are held by one task."""

    def each(t: pa.Table) -> pa.Table:
        src, dst, w, bits = (t[c].to_numpy() for c in ("src", "dst", "w", "signs"))
        names, at = np.unique(src, return_inverse=True)
        own = np.zeros(len(names), np.int64)
        own[at[src == dst]] = bits[src == dst]
        to, n = np.searchsorted(names, dst), len(names)
        nodes, live = [], 0
        for p in range(probes):
            sign = np.where((own >> p) & 1, -1.0, 1.0)
            if n * (1 - sign.mean() ** 2) > 0.5:
                live += 1
                nodes.append(_quadrature(*_recurrence(names, at, to, w, sign, steps)))
        theta = np.concatenate([[0.0], *[x for x, _ in nodes]])
        weight = np.concatenate([[1.0 if live else float(n)], *[x * (n - 1) / live for _, x in nodes]])
        return pa.table({"section": pa.array(np.full(len(theta), t["section"][0].as_py()), pa.int32()), "theta": theta, "weight": weight})

    if probes > 63:
        raise ValueError("more than 63 probes")
    signs = sum((F.shiftleft(F.xxhash64("src", F.lit(seed), F.lit(p)).bitwiseAND(1), p) for p in range(probes)), F.lit(0).cast("long"))
    rows = matrix.select(F.col("section").cast("int").alias("section"), "src", "dst", "w", signs.alias("signs"))
    return rows.groupBy("section").applyInArrow(each, "section int, theta double, weight double")


def spectrum(matrix: DataFrame, small: int = 400, probes: int = 16, steps: int = 40, seed: int = 0, whole: int = WHOLE) -> DataFrame:
    """section, theta, weight, exact: sections of at most small cells by their eigenvalues, larger ones by quadrature."""
    sizes = cut(matrix.groupBy("section").agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("n"), F.count(F.lit(1)).alias("entries")))
    few, fit = F.col("n") <= small, F.col("entries") <= whole
    named = [sizes.filter(c).select("section") for c in (few, ~few & fit, ~few & ~fit)]
    low, middle, large = (matrix.join(x, "section", "left_semi") for x in named)
    out = exact(low).withColumn("exact", F.lit(True))
    out = out.unionByName(lanczos_by_section(middle, probes, steps, seed).withColumn("exact", F.lit(False)))
    if sizes.filter(~few & ~fit).isEmpty():
        return out
    return out.unionByName(lanczos(large, probes, steps, seed).withColumn("exact", F.lit(False)))


def traces(nodes: DataFrame, rho: float) -> DataFrame:
    """section, n, log_det = ln det(I + rho L), inverse = tr (I + rho L)^-1, slope = d ln inverse / d ln rho, total = tr L."""
    t, x = F.col("theta"), F.col("weight")
    inverse = F.sum(x / (1 + rho * t))
    out = nodes.groupBy("section").agg(F.sum(x).alias("n"), F.sum(x * F.log1p(rho * t)).alias("log_det"), inverse.alias("inverse"), F.sum(x * t / (1 + rho * t) ** 2).alias("d"), F.sum(x * t).alias("total"))
    return out.select("section", "n", "log_det", "inverse", (-rho * F.col("d") / F.col("inverse")).alias("slope"), "total")


def _conjugate(product, diag: np.ndarray, b: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, int]:
    """(x with product(x) = b, steps); see _solve_by_steps(). most + 1 steps stand for a residual that stays above tol."""
    x, r, p = np.zeros(len(b)), b.copy(), b / diag
    rz, rr = float(r @ p), float(r @ r)
    goal, step = tol * tol * rr, 0
    while rr > goal and rr > 0:
        step += 1
        if step > most:
            break
        q = product(p)
        a = rz / float(p @ q)
        x += a * p
        r -= a * q
        z, before = r / diag, rz
        rz, rr = float(r @ z), float(r @ r)
        p = z + rz / before * p
    return x, step


def _solve_by_section(matrix: DataFrame, right: DataFrame, columns: list[str], shift: float, scale: float, tol: float, most: int) -> DataFrame:
    """section, cell, x (as many numbers as columns), steps; a section's matrix, right sides and one column's vectors are held by one task."""

    def each(t: pa.Table, m: pa.Table) -> pa.Table:
        order = np.argsort(t["cell"].to_numpy(), kind="stable")
        names = t["cell"].to_numpy()[order]
        b = t["b"].combine_chunks().flatten().to_numpy().reshape(len(names), -1)[order]
        src, dst = (np.searchsorted(names, m[c].to_numpy()) for c in ("src", "dst"))
        rows = np.lexsort((dst, src))
        src, dst, w = src[rows], dst[rows], m["w"].to_numpy()[rows]
        first, own = np.searchsorted(src, np.arange(len(names))), src == dst
        diag = shift + scale * np.bincount(src[own], weights=w[own], minlength=len(names))
        x, steps = np.zeros(b.shape), 0
        for i in range(b.shape[1]):
            x[:, i], n = _conjugate(lambda p: shift * p + scale * np.add.reduceat(w * p[dst], first), diag, np.ascontiguousarray(b[:, i]), tol, most)
            steps = max(steps, n)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), b.shape[1]).cast(pa.list_(pa.float64()))
        return pa.table({"section": pa.array(np.full(len(names), t["section"][0].as_py()), t["section"].type), "cell": names, "x": lists, "steps": pa.array(np.full(len(names), steps, np.int32))})

    b = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("b")
    sides = matrix.filter("src = dst").select("section", F.col("src").alias("cell")).join(right.select("cell", b), "cell", "left")
    sides = sides.select("section", "cell", F.coalesce("b", F.array(*[F.lit(0.0) for _ in columns])).alias("b"))
    types = {c: matrix.schema[c].dataType.simpleString() for c in ("section", "src")}
    return sides.groupBy("section").cogroup(matrix.select(F.col("section").alias("of"), "src", "dst", "w").groupBy("of")).applyInArrow(each, f"section {types['section']}, cell {types['src']}, x array<double>, steps int")


def solve(matrix: DataFrame, right: DataFrame, columns: list[str], shift: float, scale: float, tol: float = 1e-8, most: int = 200, whole: int = WHOLE) -> tuple[DataFrame, int]:
    """(cell, section and the columns of X in (shift I + scale L) X = B, steps) by conjugate gradients with the diagonal as preconditioner.

    right: cell and the columns of B (missing cells: 0). Each section and column has its own step lengths and
    stops for itself; raises if some residual is above tol times B's norm after `most` steps. Sections of at most `whole` entries
    and NUMBERS cells x columns are one Arrow group each, all steps in one task; for others a step is a join, and two tables are written.
    """
    matrix = cut(matrix)
    sizes = cut(matrix.groupBy("section").agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("n"), F.count(F.lit(1)).alias("entries")))
    fit = (F.col("entries") <= whole) & (F.col("n") * len(columns) <= NUMBERS)
    small, large = (sizes.filter(c).select("section") for c in (fit, ~fit))
    x = cut(_solve_by_section(matrix.join(small, "section", "left_semi"), right, columns, shift, scale, tol, most))
    steps = x.agg(F.max("steps")).first()[0] or 0
    if steps > most:
        raise ValueError(f"conjugate gradients did not reach {tol} in {most} steps")
    out = x.select("cell", "section", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)])
    if large.isEmpty():
        return out, steps
    more, n = _solve_by_steps(matrix.join(large, "section", "left_semi"), right, columns, shift, scale, tol, most)
    return out.unionByName(more), max(steps, n)


def _solve_by_steps(matrix: DataFrame, right: DataFrame, columns: list[str], shift: float, scale: float, tol: float, most: int) -> tuple[DataFrame, int]:
    """solve() by one join with the matrix a step, whatever a section's size."""
    matrix = cut(matrix)
    diag = matrix.filter("src = dst").select("section", F.col("src").alias("cell"), (shift + scale * F.col("w")).alias("diag"))
    kinds = {k: [f"{k}_{i}" for i in range(len(columns))] for k in ("x", "r", "z", "p", "q")}
    first = diag.join(right.select("cell", *[F.col(c).alias(f"in_{c}") for c in columns]), "cell", "left")
    b = [F.coalesce(F.col(f"in_{c}").cast("double"), F.lit(0.0)) for c in columns]
    now = cut(first.select("section", "cell", "diag", *[F.lit(0.0).alias(c) for c in kinds["x"]], *[x.alias(c) for x, c in zip(b, kinds["r"], strict=True)], *[(x / F.col("diag")).alias(c) for x, c in zip(b, kinds["p"], strict=True)]))
    n = range(len(columns))
    state = sums(now, **{f"rz{i}": F.col(f"r_{i}") * F.col(f"p_{i}") for i in n}, **{f"rr{i}": F.col(f"r_{i}") ** 2 for i in n})
    goal = {s: {i: tol * tol * d[f"rr{i}"] for i in n} for s, d in state.items()}
    for step in range(most + 1):
        open_ = {(s, i) for s, d in state.items() for i in n if d[f"rr{i}"] > goal[s][i] and d[f"rr{i}"] > 0}
        if not open_:
            out = now.select("cell", "section", *[F.col(f"x_{i}").alias(c) for i, c in enumerate(columns)])
            return out, step
        if step == most:
            raise ValueError(f"conjugate gradients did not reach {tol} in {most} steps")
        got = product(matrix, now, kinds["p"], kinds["q"], ["diag", *kinds["x"], *kinds["r"]])
        got = cut(got.withColumns({f"q_{i}": shift * F.col(f"p_{i}") + scale * F.col(f"q_{i}") for i in n}))
        curve = sums(got, **{f"pq{i}": F.col(f"p_{i}") * F.col(f"q_{i}") for i in n}, **{f"rq{i}": F.col(f"r_{i}") * F.col(f"q_{i}") / F.col("diag") for i in n}, **{f"qq{i}": F.col(f"q_{i}") ** 2 / F.col("diag") for i in n})
        use: dict = {}
        for s, d in curve.items():
            use[s] = {}
            for i in n:
                a = state[s][f"rz{i}"] / d[f"pq{i}"] if (s, i) in open_ else 0.0
                fresh = state[s][f"rz{i}"] - 2 * a * d[f"rq{i}"] + a * a * d[f"qq{i}"]  # r'z after the step, from this pass
                use[s] |= {f"a{i}": a, f"b{i}": max(fresh, 0.0) / state[s][f"rz{i}"] if (s, i) in open_ else 0.0}
        held = scaled(got, use)
        held = held.withColumns({**{f"x_{i}": F.col(f"x_{i}") + F.col(f"a{i}") * F.col(f"p_{i}") for i in n}, **{f"r_{i}": F.col(f"r_{i}") - F.col(f"a{i}") * F.col(f"q_{i}") for i in n}})
        now = cut(held.select("section", "cell", "diag", *kinds["x"], *kinds["r"], *[(F.col(f"r_{i}") / F.col("diag") + F.col(f"b{i}") * F.col(f"p_{i}")).alias(f"p_{i}") for i in n]))
        state = sums(now, **{f"rz{i}": F.col(f"r_{i}") ** 2 / F.col("diag") for i in n}, **{f"rr{i}": F.col(f"r_{i}") ** 2 for i in n})
    raise AssertionError
