"""Sums of products for models and decompositions: packed blocks that tasks add up in a tree, and lagged designs without lagged rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import dealt, ordered

BLOCK = 65_536  # numbers in a block
_SUMS = "of int, block int, part int, v binary"


def _blocks(of: int, values: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    values = np.ascontiguousarray(values, dtype=float).ravel()
    for k, at in enumerate(range(0, len(values), BLOCK)):
        yield pa.RecordBatch.from_pydict({"of": pa.array([of], pa.int32()), "block": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "v": pa.array([values[at : at + BLOCK].tobytes()], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block for all that come with its name; a task holds as many as there are names."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for of, block, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            own = np.frombuffer(v.as_buffer(), dtype=float)
            held[of, block] = held[of, block] + own if (of, block) in held else own.copy()
    part = TaskContext.get().partitionId()
    for (of, block), v in held.items():
        yield pa.RecordBatch.from_pydict({"of": pa.array([of], pa.int32()), "block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})


def partial_sums(rows: DataFrame, of: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> DataFrame:
    """Each task's sums over its batches of the arrays that ``of`` gives under their numbers, in packed blocks: ``of, block, part, v``, one row for each array, block and task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in of(batch).items():
                    held[k] = held[k] + v if k in held else v
        for k, v in held.items():
            yield from _blocks(k, v, TaskContext.get().partitionId())

    return rows.mapInArrow(part, _SUMS)


def tree_sum(parts: DataFrame, width: int = 32) -> dict[int, np.ndarray]:
    """The arrays of ``partial_sums`` added up over all tasks: blocks of every ``width``-th task first, then those sums. Only the totals reach the driver."""
    cores = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for salt in (F.col("part") % width, F.lit(0)):
        parts = parts.repartition(cores, "of", "block", salt).mapInArrow(_added, _SUMS)
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.toArrow().to_pylist():
        own = out.setdefault(r["of"], {})
        v = np.frombuffer(r["v"], dtype=float)
        own[r["block"]] = own[r["block"]] + v if r["block"] in own else v
    return {k: np.concatenate([v[b] for b in sorted(v)]) for k, v in out.items()}


def packed(square: np.ndarray) -> np.ndarray:
    return square[np.triu_indices(len(square))]


def unpacked(v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = v
    return out + np.triu(out, 1).T


def stacked(column: pa.Array) -> np.ndarray:
    """Arrays of equal length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fold_grams(rows: DataFrame, p: int, q: int, fold: str = "fold") -> dict[int, np.ndarray]:
    """For each fold the (1 + p + q)-square sums of products of [1, x, y] (arrays ``x`` and ``y``)."""
    d = 1 + p + q

    def of(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        folds = batch.column(0).to_numpy(zero_copy_only=False)
        z = np.hstack([np.ones((batch.num_rows, 1)), stacked(batch.column(1)), stacked(batch.column(2))])
        return {int(f): packed(own.T @ own) for f in np.unique(folds) for own in [z[folds == f]]}

    return {f: unpacked(v, d) for f, v in tree_sum(partial_sums(rows.select(F.col(fold).cast("int"), "x", "y"), of)).items()}


def reached(rows: DataFrame, key: list[str], frame: str, low: int, high: int, samples: int) -> DataFrame:
    """``rows`` with ``_n, _p, _chunk``: each frame goes to the chunks of ``samples`` frames that reach it by the lags ``low`` to ``high``, around the ends of its recording.

    ``_p`` is its place as the chunk sees it, before 0 or past the end where a lag goes around. A frame far from the borders of chunks goes to one.
    """
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    held = rows.join(n, key) if key else rows.crossJoin(F.broadcast(n))
    turns = F.ceil(F.lit(max(abs(low), abs(high))) / F.col("_n"))
    places = F.filter(F.transform(F.sequence(-turns, turns), lambda k: F.col(frame) + k * F.col("_n")), lambda p: (p >= low) & (p < F.col("_n") + high))
    held = held.withColumn("_p", F.explode(places))
    first, last = F.greatest(F.lit(0), F.floor((F.col("_p") - high) / samples)), F.least(F.floor((F.col("_n") - 1) / samples), F.floor((F.col("_p") - low) / samples))
    return held.where(first <= last).withColumn("_chunk", F.explode(F.sequence(first, last)))


def fold_starts(n: int, k: int) -> np.ndarray:
    """First frames of contiguous folds, of which the first n mod k are one longer, and n."""
    return np.concatenate([[0], np.cumsum([n // k + (i < n % k) for i in range(k)])]).astype(int)


def lagged_grams(rows: DataFrame, key: list[str], frame: str, x: str, y: str, lags: list[list[int]], folds: int, samples: int = 16_384) -> tuple[dict[int, np.ndarray], int, int]:
    """What ``fold_grams`` gives for circularly lagged columns, and the numbers of columns and outputs, without a row or a column for each lag.

    ``rows``: a row for each frame of a recording, numbered from 0 without gaps, with arrays of signals and outputs. ``lags``: for each signal its lags, in the order of columns; column ``(signal, lag)`` is the signal ``lag`` frames on.
    The products of columns at lags l and m sum to those at l + 1 and m + 1, less the product at the fold's first frame and plus that one past its last. So a fold's sums follow from those at the
    lowest lag, which are cross-correlations at differences of lags, and the frames around its borders. Recordings of several keys are lagged apart and their sums added.
    """
    low, high, d = min(map(min, lags)), max(map(max, lags)), len(lags)
    w = high - low + 1
    q = rows.select(F.max(F.size(y)).alias("q")).first().q or 0
    by = [*key, "_chunk"]
    held = dealt(reached(rows.select(*key, frame, F.col(x).alias("_x"), F.col(y).alias("_y")), key, frame, low, high, samples).select(*by, "_n", "_p", "_x", "_y"), by)

    def part(table: pa.Table) -> pa.Table:
        table = ordered(table, "_p")
        p, n, chunk = table.column("_p").to_numpy(), table.column("_n")[0].as_py(), table.column("_chunk")[0].as_py()
        # places of each value seen from the chunk, in order and without gaps
        s, out, first = stacked(table.column("_x")), stacked(table.column("_y")), int(p[0])
        starts, names, values = fold_starts(n, folds), [], []
        a0, b0 = chunk * samples, min(n, (chunk + 1) * samples)
        for f in range(folds):
            a, b = max(a0, int(starts[f])), min(b0, int(starts[f + 1]))
            if a >= b:
                continue
            at = lambda v, lag, a=a, b=b: v[a + lag - first : b + lag - first]
            base = at(s, low)
            corr = np.stack([base.T @ at(s, low + k) for k in range(w)])  # differences of lags x signals x signals
            target = at(out, 0)
            cross = np.stack([at(s, low + k).T @ target for k in range(w)])
            total = np.stack([at(s, low + k).sum(0) for k in range(w)])
            # products over the border at the start of the fold, and, for the fold before, over its end
            values.append(np.concatenate([[b - a], corr.ravel(), cross.ravel(), total.ravel(), target.sum(0), packed(target.T @ target)]))
            names.append(3 * f)
            if a == starts[f]:
                near = s[a + low - first : a + high + 1 - first]
                products = border(near)
                values += [products, products]
                names += [3 * f + 1, 3 * ((f - 1) % folds) + 2]
        blocks = [b for name, v in zip(names, values) for b in _blocks(name, v, chunk % 2**31)]
        return pa.Table.from_batches(blocks) if blocks else pa.table({"of": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "v": pa.array([], pa.binary())})

    def border(near: np.ndarray) -> np.ndarray:
        """Running sums along equal differences of lags of the products of the frames around a border."""
        out = np.zeros((w, w, d, d))  # lag of the first, difference
        for k in range(w):
            run = np.einsum("ij,ik->ijk", near[: w - 1 - k], near[k : w - 1])
            out[1 : w - k, k] = np.cumsum(run, 0)
        return np.concatenate([out.ravel()])

    sums = tree_sum(held.groupBy(by).applyInArrow(part, _SUMS))
    columns = [(j, lag - low) for j, own in enumerate(lags) for lag in own]
    sig, place = np.array([j for j, _ in columns]), np.array([k for _, k in columns])
    count, out = len(columns), {}
    for f in range(folds):
        v = sums.get(3 * f)
        if v is None:
            continue
        cut = np.cumsum([1, w * d * d, w * d * q, w * d, q])
        m, corr, cross, total, ty, yy = (part for part in np.split(v, cut))
        corr, cross, total = corr.reshape(w, d, d), cross.reshape(w, d, q), total.reshape(w, d)
        step = (sums[3 * f + 2] - sums[3 * f + 1]).reshape(w, w, d, d)
        earlier = np.minimum(place[:, None], place)
        apart = np.abs(place[:, None] - place)
        # of two columns the one of the lower lag comes first in a cross-correlation
        swap = place[:, None] > place
        i, j = np.where(swap, sig[None, :], sig[:, None]), np.where(swap, sig[:, None], sig[None, :])
        g = np.zeros((1 + count + q, 1 + count + q))
        g[0, 0] = m[0]
        g[1 : 1 + count, 1 : 1 + count] = corr[apart, i, j] + step[earlier, apart, i, j]
        g[0, 1 : 1 + count] = g[1 : 1 + count, 0] = total[place, sig]
        g[1 : 1 + count, 1 + count :] = cross[place, sig]
        g[1 + count :, 1 : 1 + count] = g[1 : 1 + count, 1 + count :].T
        g[0, 1 + count :] = g[1 + count :, 0] = ty
        g[1 + count :, 1 + count :] = unpacked(yy, q)
        out[f] = g
    return out, count, q


def lagged_predict(rows: DataFrame, key: list[str], frame: str, x: str, lags: list[list[int]], folds: int, fitted: dict, samples: int = 16_384) -> DataFrame:
    """``key, frame, predicted``: out-of-fold predictions of a model of lagged columns, each frame by its own fold's coefficients; chunks filter their signals."""
    low, high = min(map(min, lags)), max(map(max, lags))
    b, c, by = fitted["coefficients"], fitted["intercepts"], [*key, "_chunk"]
    held = dealt(reached(rows.select(*key, frame, F.col(x).alias("_x")), key, frame, low, high, samples).select(*by, "_n", "_p", "_x"), by)

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table, "_p")
        n, chunk, first = table.column("_n")[0].as_py(), table.column("_chunk")[0].as_py(), table.column("_p")[0].as_py()
        s, starts = stacked(table.column("_x")), fold_starts(n, folds)
        a0, b0 = chunk * samples, min(n, (chunk + 1) * samples)
        made = []
        for f in range(folds):
            a, e = max(a0, int(starts[f])), min(b0, int(starts[f + 1]))
            if a < e:
                made.append(c[f] + sum(np.outer(s[a + lag - first : e + lag - first, j], b[f][k]) for k, (j, lag) in enumerate((j, lag) for j, own in enumerate(lags) for lag in own)))
        own = {k: table.column(k).slice(0, 1).take(pa.array(np.zeros(b0 - a0, int))) for k in key}
        return pa.table({**own, frame: pa.array(np.arange(a0, b0)), "predicted": pa.array(list(np.concatenate(made)), pa.list_(pa.float64()))})

    types = dict(rows.dtypes)
    return held.groupBy(by).applyInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in key), f"`{frame}` long", "predicted array<double>"]))
