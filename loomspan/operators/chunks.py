"""Filters of long recordings in chunks: no task holds a recording.

Series are in long form, ``index`` counting from 0 without gaps within a key. A chunk is a fixed number of consecutive samples and is the group of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

SAMPLES = 65_536


def _schema(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in names)


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """Dealt by the columns of a group, into as many parts as the session shuffles to: small tables of many short series keep all cores busy."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def in_groups(df: DataFrame, by: list[str], order: list, make: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``make(table, starts)`` of tables that hold whole groups in order, ``starts`` the first row of each.

    A table has all groups that end in a batch of Arrow, so that short groups cost no call of their own; a task holds a batch and the rows of one group.
    """
    names = df.columns
    rows = dealt(df, by).withColumn("_opens", F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1)

    def made(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        if table.num_rows:
            yield from make(table.select(names), np.flatnonzero(table.column("_opens").to_numpy())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            opens = np.flatnonzero(table.column("_opens").to_numpy())
            if len(opens):  # the last group may go on in the next batch
                yield from made([*held, table.slice(0, opens[-1])])
                held, table = [], table.slice(opens[-1])
            held.append(table)
        if held:
            yield from made(held)

    return rows.mapInArrow(run, schema)


def ordered(table: pa.Table, column: str) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column(column).to_numpy(), kind="stable")))


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(float)


def with_key(table: pa.Table, key: list[str], columns: dict) -> pa.Table:
    """One row of the group's key and the given values."""
    return pa.table({**{k: table.column(k).slice(0, 1) for k in key}, **{c: v if isinstance(v, pa.Array) else pa.array([v]) for c, v in columns.items()}})


def gauss1d(df: DataFrame, key: list[str], index: str, column: str, sigma: float, out: str, samples: int = SAMPLES, counted: DataFrame | None = None) -> DataFrame:
    """Gaussian smoothing with mirrored ends (the end sample repeated). ``counted``: a cheaper table with the same rows, to count.

    A chunk also gets the samples that its border ones reach, mirrored past the ends of the recording, so a sample is sent once, and near a border twice.
    """
    r = int(4.0 * sigma + 0.5)
    length = (df if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    period = 2 * F.col("_n")
    turns = F.ceil((F.col("_n") + r) / period)
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(F.col(index) + k * period, k * period - 1 - F.col(index))))
    rows = df.join(length, key).withColumn("_p", F.explode(F.filter(places, lambda p: (p >= -r) & (p < F.col("_n") + r))))
    last = F.floor((F.col("_n") - 1) / samples)
    chunk = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_p") - r) / samples)), F.least(last, F.floor((F.col("_p") + r) / samples)))
    rows = rows.withColumn("_chunk", F.explode(chunk)).withColumn("_own", (F.col("_p") == F.col(index)) & (F.floor(F.col("_p") / samples) == F.col("_chunk")))
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    names = df.columns

    def smooth(table: pa.Table) -> pa.Table:
        table = ordered(table, "_p")
        own = table.filter(table.column("_own")).select(names)
        return own.append_column(out, pa.array(np.convolve(numbers(table, column), taps, "valid")))

    by = [*key, "_chunk"]
    return dealt(rows.select(*df.columns, "_p", "_chunk", "_own"), by).groupBy(by).applyInArrow(smooth, _schema(df, df.columns) + f", `{out}` double")


def temporal_filter(df: DataFrame, key: list[str], index: str, column: str, fs: float = 20.0, fcutoff: float | None = 0.1, sigma: float = 0.0, out: str = "filtered", order: int = 2, padlen: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """Zero-phase Butterworth high-pass per series, forward and backward, its mean put back, and Gaussian smoothing; without ``fcutoff`` no high-pass.

    What a chunk does to the state of the filter is an affine map: a matrix that only its length fixes, and what it leaves in a filter at rest. Both directions' remainders come from one
    pass over the samples. A scan over the chunks of a recording, a few numbers each, composes the maps, so that every chunk's states are known, and each is filtered by itself in a
    second pass. Ends are extended oddly as in ``kernels.highpass``, which gives the same result; a series of one sample stays as it is.
    """
    if fcutoff is None:
        done = df.withColumn(out, F.col(column).cast("double"))
    else:
        done = _highpass(df, key, index, column, kernels.butterworth(fs, fcutoff, order), out, order, padlen, samples)
    if not sigma:
        return done
    return gauss1d(done.withColumnRenamed(out, "_high"), key, index, "_high", sigma, out, samples, df).drop("_high")


def _highpass(df: DataFrame, key: list[str], index: str, column: str, sections: list, out: str, order: int, padlen: int | None, samples: int) -> DataFrame:
    m, most = 2 * len(sections), 3 * (order + 1) if padlen is None else padlen
    rest, names = np.zeros((len(sections), 2)), df.columns
    by = [*key, "_chunk"]
    rows = dealt(df.withColumn("_chunk", F.floor(F.col(index) / samples)), by)

    def backward(y: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, state = kernels.through(sections, y[::-1], state)
        return y[::-1], state

    def summary(table: pa.Table) -> pa.Table:
        x = numbers(ordered(table, index), column)
        y, after = kernels.through(sections, x, rest)
        own = {"_n": len(x), "_sum": x.sum(), "_after": after.ravel(), "_before": backward(y, rest)[1].ravel(), "_head": x[: most + 1], "_tail": x[-most - 1 :]}
        return with_key(table, by, own)

    def scan(table: pa.Table) -> pa.Table:
        table = ordered(table, "_chunk")
        length, after, before = table.column("_n").to_pylist(), table.column("_after").to_pylist(), table.column("_before").to_pylist()
        n = sum(length)
        mean = pa.array(np.full(len(length), numbers(table, "_sum").sum() / n))
        if n < 2:
            return table.select(by).append_column("_mean", mean).append_column("_forward", pa.array([None], pa.list_(pa.float64()))).append_column("_backward", pa.array([None], pa.list_(pa.float64())))
        # ends of the recording, from as many chunks as they span
        pad, head, tail = kernels.extension(n, order, padlen), np.zeros(0), np.zeros(0)
        for x in table.column("_head").to_pylist():
            head = np.concatenate([head, x])
            if len(head) > pad:
                break
        for x in table.column("_tail").to_pylist()[::-1]:
            tail = np.concatenate([x, tail])
            if len(tail) > pad:
                break
        left, right = 2 * head[0] - head[pad:0:-1], 2 * tail[-1] - tail[-2 : -pad - 2 : -1]
        first = left[0] if pad else head[0]
        state = kernels.through(sections, left, kernels.settled(sections) * first)[1]
        maps, forward = {}, []
        for k in set(length):
            y, moved = kernels.through(sections, np.zeros((k, m)), np.eye(m).reshape(len(sections), 2, m))
            maps[k] = moved.reshape(m, m), kernels.through(sections, y[::-1], np.zeros((len(sections), 2, m)))[1].reshape(m, m)
        for k, own in zip(length, after):
            forward.append(state.ravel())
            state = (maps[k][0] @ state.ravel() + own).reshape(rest.shape)
        y = kernels.through(sections, right, state)[0]
        if not pad or not len(y):
            raise ValueError("a filter needs an extension of at least one sample")
        state, back = backward(y, kernels.settled(sections) * y[-1])[1], []
        for k, own, start in zip(length[::-1], before[::-1], forward[::-1]):
            back.append(state.ravel())
            state = (maps[k][0] @ state.ravel() + own + maps[k][1] @ start).reshape(rest.shape)
        return table.select(by).append_column("_mean", mean).append_column("_forward", pa.array(forward)).append_column("_backward", pa.array(back[::-1]))

    def run(table: pa.Table, states: pa.Table) -> pa.Table:
        table, at = ordered(table, index).select(names), states.to_pylist()[0]
        y = np.zeros(table.num_rows)
        if at["_forward"] is not None:
            y = kernels.through(sections, numbers(table, column), np.reshape(at["_forward"], rest.shape))[0]
            y = backward(y, np.reshape(at["_backward"], rest.shape))[0]
        return table.append_column(out, pa.array(y + at["_mean"]))

    known = _schema(rows, by)
    summaries = rows.groupBy(by).applyInArrow(summary, f"{known}, _n long, _sum double, _after array<double>, _before array<double>, _head array<double>, _tail array<double>")
    states = dealt(summaries, key).groupBy(key).applyInArrow(scan, f"{known}, _mean double, _forward array<double>, _backward array<double>")
    return rows.groupBy(by).cogroup(dealt(states, by).groupBy(by)).applyInArrow(run, _schema(df, df.columns) + f", `{out}` double")
