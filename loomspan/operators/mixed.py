"""Group contrasts of mixed models: REML with one random intercept or two nested ones, and Satterthwaite's degrees of freedom.

Spark reduces rows to a count, a mean and a sum of squared deviations for each subject, inner unit (a day, say) and cell of the fixed effects. All that a fit asks of these, for a pair of variance ratios, are sums over
subjects. A fit is a generator that yields pairs of ratios and is sent those sums: a small group of rows is fitted in a task, and the sums of large groups come from blocks of subjects, one pass over all blocks for what
all large groups ask at a time. So no task holds a large group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialised
from .gram import partial_sums, tree_sum
from .kernels import student_limit, student_two_sided


class Block:
    """Sums over subjects for the normal equations of ``y = design[cell] @ beta + subject + inner + noise``, for any ratios of the two variances to that of the noise.

    Rows are in the order of their units, and units in that of their subjects; ``unit`` and ``subject`` (of each unit) count from 0. The inverse of a subject's covariance follows from those of its units
    (a constant plus a diagonal each), and one more constant over the subject. A unit's share depends on its size alone, so those of one size are summed once.
    """

    def __init__(self, cells: int, cell: np.ndarray, unit: np.ndarray, subject: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: float):
        units = len(subject)
        self.counts = np.bincount(unit * cells + cell, n, units * cells).reshape(units, cells)
        self.unit_sum, self.unit_n = np.bincount(unit, sums, units), self.counts.sum(1)
        self.first = np.flatnonzero(np.append(True, subject[1:] != subject[:-1]))
        self.cell_n, self.cell_sum, self.squares = np.bincount(cell, n, cells), np.bincount(cell, sums, cells), squares
        self.sizes, self.size = np.unique(self.unit_n, return_inverse=True)
        order = np.argsort(self.size, kind="stable")
        self.units = np.bincount(self.size, minlength=len(self.sizes))
        own = np.split(order, np.cumsum(self.units)[:-1])
        self.square = np.array([(self.counts[i].T @ self.counts[i]).ravel() for i in own])
        self.cross = np.array([self.unit_sum[i] @ self.counts[i] for i in own])
        self.squared = np.array([self.unit_sum[i] @ self.unit_sum[i] for i in own])

    def sums(self, points: list[tuple[float, float]]) -> np.ndarray:
        """For each pair of an outer and an inner ratio ``X'WX``, ``X'Wy``, ``y'Wy`` over cells and the log determinant of the covariance, in one row; in units of the noise's variance, W its inverse."""
        out = []
        for outer, inner in points:
            own = 1 / (1 + inner * self.sizes)
            a, b = np.diag(self.cell_n) - (inner * own @ self.square).reshape(len(self.cell_n), -1), self.cell_sum - inner * own @ self.cross
            q, det = self.squares - inner * own @ self.squared, -(self.units * np.log(own)).sum()
            if outer > 0:
                own = own[self.size]
                weight, total = np.add.reduceat(own * self.unit_n, self.first), np.add.reduceat(own * self.unit_sum, self.first)
                seen = np.add.reduceat(self.counts * own[:, None], self.first)
                f = outer / (1 + outer * weight)
                a, b, q, det = a - seen.T @ (seen * f[:, None]), b - seen.T @ (f * total), q - f @ total**2, det + np.log1p(outer * weight).sum()
            out.append(np.concatenate([a.ravel(), b, [q, det]]))
        return np.array(out)


class Reml:
    """The restricted likelihood of a design of cells, from what ``Block.sums`` gives for a pair of ratios."""

    def __init__(self, design: np.ndarray, rows: float):
        self.design, self.rank, self.rows = design, int(np.linalg.matrix_rank(design)), rows

    def solved(self, sums: np.ndarray):
        """Inverse of the normal matrix, coefficients, weighted squares of the residuals, and both log determinants."""
        cells = len(self.design)
        a, b, (q, det) = sums[: cells * cells].reshape(cells, cells), self.design.T @ sums[cells * cells : -2], sums[-2:]
        a = self.design.T @ a @ self.design
        values, vectors = np.linalg.eigh((a + a.T) / 2)
        values, vectors = values[len(values) - self.rank :], vectors[:, len(values) - self.rank :]
        inverse = (vectors / values) @ vectors.T
        beta = inverse @ b
        return inverse, beta, max(float(q) - float(b @ beta), 1e-300), float(det) + float(np.log(values).sum())

    def deviance(self, noise: float, sums: np.ndarray) -> float:
        """-2 log of the restricted likelihood, but for a constant."""
        _, _, squares, det = self.solved(sums)
        return (self.rows - self.rank) * np.log(noise) + det + squares / noise

    def profile(self, sums: np.ndarray) -> float:
        _, _, squares, det = self.solved(sums)
        return (self.rows - self.rank) * np.log(squares) + det

    def fit(self, nested: bool):
        """The ratios of least deviance. A ratio at its border is exactly 0: each set of ratios above 0 is tried, the smaller set if it is no worse. Without ``nested`` units are subjects."""
        best, at = self.profile((yield [(0.0, 0.0)])[0]), (0.0, 0.0)
        for free in ([0], [1], [0, 1]) if nested else ([1],):

            def ratios(x, free=free):
                out = [0.0, 0.0]
                for k, v in zip(free, x):
                    out[k] = float(np.exp(v))
                return tuple(out)

            def f(xs, ratios=ratios):
                return [self.profile(v) for v in (yield [ratios(x) for x in xs])]

            grid = np.linspace(-12.0, 8.0, 21 if len(free) == 1 else 11)
            grid = np.stack(np.meshgrid(*[grid] * len(free)), -1).reshape(-1, len(free))
            x, here = yield from descend(f, grid[int(np.argmin((yield from f(grid))))])
            if (x > -20).all() and here < best - 1e-7:
                best, at = here, ratios(x)
        return at


def stencil(x: np.ndarray, h: float) -> list[np.ndarray]:
    """The places that ``differences`` needs the values at."""
    unit = np.eye(len(x))
    out = [x]
    for s in (h, h / 2):
        out += [x + d * s * e for e in unit for d in (1, -1)]
        out += [x + s * (c * unit[i] + d * unit[j]) for i in range(len(x)) for j in range(i) for c in (1, -1) for d in (1, -1)]
    return out


def differences(values: list[float], k: int, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives by central differences, extrapolated from two steps."""
    here, rest = values[0], iter(values[1:])

    def at(h):
        g, m = np.zeros(k), np.zeros((k, k))
        for i in range(k):
            up, down = next(rest), next(rest)
            g[i], m[i, i] = (up - down) / (2 * h), (up - 2 * here + down) / h**2
        for i in range(k):
            for j in range(i):
                m[i, j] = m[j, i] = (next(rest) - next(rest) - next(rest) + next(rest)) / (4 * h * h)
        return g, m

    (g1, m1), (g2, m2) = at(h), at(h / 2)
    return (4 * g2 - g1) / 3, (4 * m2 - m1) / 3


def slopes(f, x: np.ndarray, h: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    return differences([f(p) for p in stencil(x, h)], len(x), h)


def descend(f, x: np.ndarray, rounds: int = 60):
    """A minimum near ``x`` by damped Newton steps, and the value there; ``f`` gives the values at a list of places as a generator."""
    values = yield from f(stencil(x, 0.004))
    for _ in range(rounds):
        here, (g, m) = values[0], differences(values, len(x), 0.004)
        w, v = np.linalg.eigh(m)
        step = -v @ ((v.T @ g) / np.maximum(np.abs(w), 1e-6))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        size, ahead = 1.0, (yield from f(stencil(x + step, 0.004)))  # most steps are taken whole, so the slopes there are asked for at once
        if ahead[0] > here + 1e-12 * abs(here):
            sizes = [0.5**k for k in range(1, 14)]
            lower = [size for size, v in zip(sizes, (yield from f([x + size * step for size in sizes]))) if v <= here + 1e-12 * abs(here)]
            if not lower:
                break
            size = lower[0]
            ahead = yield from f(stencil(x + size * step, 0.004))
        x, values = x + size * step, ahead
        if np.abs(step).max() * size < 1e-7 or (x < -20).any():  # a ratio of exp(-20) is 0
            break
    return x, values[0]


def satterthwaite(model: Reml, outer: float, inner: float, contrasts: np.ndarray):
    """Estimates, variances and degrees of freedom of contrasts: twice the squared variance over the variance's own variance.

    The latter comes from the curvature of the deviance in the logarithms of the noise's variance and of the ratios above 0.
    """
    ratios, free = np.array([outer, inner]), [k for k, v in enumerate((outer, inner)) if v > 0]
    inverse, beta, squares, _ = model.solved((yield [(outer, inner)])[0])
    noise = squares / (model.rows - model.rank)

    def point(x):
        r = ratios.copy()
        r[free] = np.exp(x[1:])
        return float(r[0]), float(r[1])

    def spread(x, inverse):
        return np.exp(x[0]) * np.einsum("ci,ij,cj->c", contrasts, inverse, contrasts)

    x = np.log(np.array([noise, *ratios[free]]))
    variance = spread(x, inverse)
    if not free:  # least squares
        return contrasts @ beta, variance, np.full(len(contrasts), model.rows - model.rank)
    steps, unit, h = 1e-3, np.eye(len(x)), 0.02
    curved, moved = stencil(x, h), [x + d * s * e for s in (steps, steps / 2) for e in unit for d in (1, -1)]
    places = list(dict.fromkeys(point(p) for p in [*curved, *moved]))
    known = dict(zip(places, (yield places)))
    curve = differences([model.deviance(np.exp(p[0]), known[point(p)]) for p in curved], len(x), h)[1]
    own = np.stack([spread(p, model.solved(known[point(p)])[0]) for p in moved]).reshape(2, len(x), 2, -1)
    first = (own[:, :, 0] - own[:, :, 1]) / (2 * np.array([steps, steps / 2]))[:, None, None]
    g = (4 * first[1] - first[0]) / 3
    of_variance = np.einsum("ic,ij,jc->c", g, 2 * np.linalg.pinv(curve), g)
    dof = np.where(of_variance > 0, 2 * variance**2 / np.where(of_variance > 0, of_variance, 1), model.rows - model.rank)
    return contrasts @ beta, variance, dof


def compared(cells: list[tuple], rows: float, nested: bool, interaction: bool, exact: bool):
    """The rows of a group's contrasts, from ``phase`` on, as a generator; ``cells`` are its sorted pairs of a group and a phase."""
    groups, phases = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
    place = {c: i for i, c in enumerate(cells)}
    own = lambda a, b: np.eye(len(cells))[place[a, b]] if interaction else np.array([1.0, *(a == x for x in groups[1:]), *(b == x for x in phases[1:])])
    model = Reml(np.stack([own(*c) for c in cells]), rows)
    if model.rows <= model.rank:
        return []
    pairs = [(c, a, b) for c in phases for i, a in enumerate(groups) for b in groups[i + 1 :] if not interaction or ((a, c) in place and (b, c) in place)]
    contrasts = np.array([own(a, c) - own(b, c) for c, a, b in pairs]).reshape(len(pairs), model.design.shape[1])
    known = np.abs(contrasts - contrasts @ np.linalg.pinv(model.design) @ model.design).max(1, initial=0) < 1e-9
    pairs, contrasts = [x for x, k in zip(pairs, known) if k], contrasts[known]
    outer, inner = yield from model.fit(nested)
    estimate, variance, dof = yield from satterthwaite(model, outer, inner, contrasts)
    out = []
    for (c, a, b), e, s, d in zip(pairs, estimate.tolist(), np.sqrt(np.maximum(variance, 0)).tolist(), dof.tolist() if exact else [float("inf")] * len(pairs)):
        wide = float(student_limit(0.05, d) * s)
        out.append((c, a, b, e, s, float(d), e - wide, e + wide, float(student_two_sided(e / s, d)) if s > 0 else (0.0 if e else 1.0)))
    return out


def answered(fits: dict, sums) -> dict:
    """What generators of fits return; ``sums`` gives the sums of all that wait, from a dict of the points that they ask for."""
    asked, out = {}, {}

    def go(k, value):
        try:
            asked[k] = fits[k].send(value)
        except StopIteration as end:
            asked.pop(k, None)
            out[k] = end.value

    for k in fits:
        go(k, None)
    while asked:
        for k, value in sums(dict(asked)).items():
            go(k, value)
    return out


def _units(subject: pd.Series, nested: pd.Series | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by subject and unit, each row's unit in that order and each unit's subject."""
    who = pd.factorize(subject)[0].astype(np.int64)
    key = who if nested is None else who * (1 + len(nested)) + pd.factorize(nested)[0]
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) != 0)
    return order, np.cumsum(new) - 1, who[order][new]


def mixed_contrasts(df: DataFrame, by: list[str], y: str, g: str, p: str, subject: str, nested: str | None = None, interaction: bool = True, exact: bool = True, task: int = 500_000, block: int = 100_000) -> DataFrame:
    """Pairwise contrasts of the groups ``g`` within each phase ``p`` of ``y ~ g * p + (1 | subject)``, one REML fit for each ``by``.

    ``nested``: also a random intercept for each value of this column within a subject, ``(1 | subject / nested)``. Without ``interaction`` the fixed part is ``g + p``.
    Inference is by Student's t with Satterthwaite's degrees of freedom, or normal without ``exact``. Columns ``by, phase, group_a, group_b, estimate, se, dof, low, high, p_value``; the limits are
    of 95 %. Rows with a null in ``y``, ``g``, ``p`` or a unit are left out; a pair that the design cannot tell apart has no row, and neither has a group of rows without a degree of freedom left.
    Groups of more than ``task`` cells of units are fitted from blocks of some ``block`` such cells, at once; only their sums reach the driver.
    """
    v = F.col(y).cast("double")
    units = [subject, *([nested] if nested else [])]
    rows = df.where(v.isNotNull() & ~F.isnan(v)).dropna(subset=[g, p, *units])
    sums = rows.groupBy(*by, *units, g, p).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("within"))
    sums = materialised(sums, "cells")
    names = [*by, "phase", "group_a", "group_b", "estimate", "se", "dof", "low", "high", "p_value"]
    types = dict(df.dtypes)
    own = ", ".join(f"`{c}` {types[c]}" for c in by)
    schema = (own + ", " if by else "") + f"phase {types[p]}, group_a {types[g]}, group_b {types[g]}, estimate double, se double, dof double, low double, high double, p_value double"

    def fit(pdf):
        cells = sorted(set(zip(pdf[g], pdf[p])))
        place = {c: i for i, c in enumerate(cells)}
        order, unit, owner = _units(pdf[subject], pdf[nested] if nested else None)
        cell = np.array([place[c] for c in zip(pdf[g], pdf[p])], dtype=int)[order]
        n, mean, within = (pdf[c].to_numpy(dtype=float)[order] for c in ("n", "mean", "within"))
        mean = mean - (n * mean).sum() / n.sum()
        own = Block(len(cells), cell, unit, owner, n, n * mean, float((within + n * mean**2).sum()))
        found = answered({0: compared(cells, n.sum(), bool(nested), interaction, exact)}, lambda asked: {0: own.sums(asked[0])})[0]
        return pd.DataFrame([(*[pdf[x].iloc[0] for x in by], *r) for r in found], columns=names)

    sizes = sums.groupBy(by).agg(F.count(F.lit(1)).alias("_cells"), F.sum("n").alias("_rows"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_centre"))
    large = sizes.where(F.col("_cells") > task).collect()  # at most one for every ``task`` cells
    if not large:
        return sums.groupBy(by).applyInPandas(fit, schema)
    spark = df.sparkSession
    same = lambda a, b, on: reduce(lambda x, c: x & a[c].eqNullSafe(b[c]), on, F.lit(True))
    numbered = spark.createDataFrame([(*r, k) for k, r in enumerate(large)], (own + ", " if by else "") + "_cells long, _rows long, _centre double, _of long")
    held = sums.join(F.broadcast(numbered), same(sums, numbered, by)).select(*[sums[c] for c in sums.columns], "_cells", "_centre", "_of")
    cells: dict[int, list[tuple]] = {}
    for r in held.select("_of", g, p).distinct().collect():
        cells.setdefault(r[0], []).append((r[1], r[2]))
    cells = {k: sorted(c) for k, c in cells.items()}
    places = spark.createDataFrame([(k, *c, i) for k, own in cells.items() for i, c in enumerate(own)], f"_of long, `{g}` {types[g]}, `{p}` {types[p]}, _cell long")
    held = held.join(F.broadcast(places), ["_of", g, p]).withColumn("_block", F.pmod(F.xxhash64(subject), F.ceil(F.col("_cells") / block)))

    def pack(pdf):
        order, unit, owner = _units(pdf[subject], pdf[nested] if nested else None)
        n, mean = pdf["n"].to_numpy(dtype=float)[order], (pdf["mean"] - pdf["_centre"]).to_numpy(dtype=float)[order]
        own = [pdf["_cell"].to_numpy()[order], unit, owner]
        return pd.DataFrame({"of": [int(pdf["_of"].iloc[0])], **{c: [x.astype("<i4").tobytes()] for c, x in zip(("cell", "unit", "owner"), own)}, "n": [n.tobytes()], "sums": [(n * mean).tobytes()], "squares": [float(pdf["within"].sum() + n @ mean**2)]})

    blocks = held.groupBy("_of", "_block").applyInPandas(pack, "of long, cell binary, unit binary, owner binary, n binary, sums binary, squares double")
    blocks = materialised(blocks, "blocks")
    width = {k: len(c) for k, c in cells.items()}

    def asked_sums(asked: dict) -> dict:
        def of(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            out: dict[int, np.ndarray] = {}
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (k := r["of"]) in asked:
                    whole = [np.frombuffer(r[c], dtype="<i4").astype(np.int64) for c in ("cell", "unit", "owner")]
                    found = Block(width[k], *whole, np.frombuffer(r["n"]), np.frombuffer(r["sums"]), r["squares"]).sums(asked[k]).ravel()
                    out[k] = out[k] + found if k in out else found
            return out

        return {k: v.reshape(len(asked[k]), -1) for k, v in tree_sum(partial_sums(blocks, of)).items()}

    found = answered({k: compared(cells[k], float(r["_rows"]), bool(nested), interaction, exact) for k, r in enumerate(large)}, asked_sums)
    made = spark.createDataFrame([(*[large[k][c] for c in by], *r) for k, rows in found.items() for r in rows], schema)
    rest = sums.join(F.broadcast(numbered), same(sums, numbered, by), "left_anti")
    return rest.groupBy(by).applyInPandas(fit, schema).unionByName(made)
