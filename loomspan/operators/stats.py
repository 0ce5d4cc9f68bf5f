"""Baselines, correlations, group comparisons and spatial binning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def baseline(df: DataFrame, key: list[str], value: str, pre: Column, how: str = "median") -> DataFrame:
    """Values less their key's median or mean where ``pre`` holds; keys without such rows vanish."""
    f = F.median if how == "median" else F.avg
    base = df.where(pre).groupBy(key).agg(f(value).alias("_base"))
    return df.join(base, key).withColumn(value, F.col(value) - F.col("_base")).drop("_base")


def map_average(df: DataFrame, by: list[str], array: str, how: str = "mean", tile: int = 16) -> DataFrame:
    """Per place of an array column, the mean or median over rows; NaN and null are ignored.

    Means are combined inside tasks. For medians a map is cut into tiles of places, and the tiles are what is sent.
    """
    if how == "mean":
        v = F.when(~F.isnan("v"), F.col("v"))
        return df.select(*by, F.posexplode(array).alias("pixel", "v")).groupBy(*by, "pixel").agg(F.avg(v).alias(how))
    size, types = F.size(array), dict(df.dtypes)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(size / tile).cast("int") - 1), lambda k: F.slice(F.col(array).cast("array<double>"), k * tile + 1, tile))
    tiles = df.where(size > 0).select(*by, F.posexplode(cut).alias("_tile", "_v"))

    def middle(table: pa.Table) -> pa.Table:
        rows = table.column("_v").combine_chunks()
        length = np.asarray(rows.value_lengths())
        held = np.full((len(rows), int(length.max())), np.nan)
        held[np.repeat(np.arange(len(rows)), length), np.concatenate([np.arange(n) for n in length])] = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
        some = ~np.isnan(held).all(0)
        found = np.full(held.shape[1], np.nan)
        found[some] = np.nanmedian(held[:, some], axis=0)
        n, first = len(found), table.slice(0, 1).take(pa.array(np.zeros(len(found), int)))
        return pa.table({**{k: first.column(k) for k in by}, "pixel": pa.array(table.column("_tile")[0].as_py() * tile + np.arange(n), pa.int32()), how: pa.array(found, mask=~some)})

    return tiles.groupBy(*by, "_tile").applyInArrow(middle, "".join(f"`{c}` {types[c]}, " for c in by) + f"pixel int, `{how}` double")


def nested_mean(df: DataFrame, first: list[str], then: list[str], value: str) -> DataFrame:
    return df.groupBy(list(dict.fromkeys([*first, *then]))).agg(F.avg(value).alias("_m")).groupBy(then).agg(F.avg("_m").alias(value))


def mean_sem(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(by).agg(F.count(value).alias("n"), p.alias("_p")).select(*by, "n", F.col("_p")[0].alias("q25"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q75"))


def t_p_value(t: Column, dof: Column) -> Column:
    """The two-sided p-value of Student's t, for one row per test; null and NaN stay null."""
    from .kernels import student_two_sided

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(a, b) for a, b in zip(t, dof)], dtype="float64")

    return p(t.cast("double"), dof.cast("double"))


def t_test(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Two-sample t of equal variance from each group's sums: ``mean_a, mean_b, sem_a, sem_b, t, dof, p_value`` (two-sided)."""
    own = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(*[f(own(g)).alias(f"{n}_{x}") for x, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    c = F.col
    pooled = ((c("n_a") - 1) * c("var_a") + (c("n_b") - 1) * c("var_b")) / (c("n_a") + c("n_b") - 2)
    t = (c("mean_a") - c("mean_b")) / F.sqrt(pooled * (1 / c("n_a") + 1 / c("n_b")))
    return s.select("mean_a", "mean_b", F.sqrt(c("var_a") / c("n_a")).alias("sem_a"), F.sqrt(c("var_b") / c("n_b")).alias("sem_b"), t.alias("t"), (c("n_a") + c("n_b") - 2).alias("dof")).withColumn("p_value", t_p_value(F.col("t"), F.col("dof")))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks within each group, ``rho, n, p_value``; ties share their mean rank. The p-value is two-sided, by t with n - 2 degrees."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 1_000_000))
    rows = rows.repartition(parts, *by)  # a task's sorts do not grow with the table; both windows and the correlation keep this order
    for c in (x, y):
        order = Window.partitionBy(by).orderBy(c)
        through = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # the rank of the last of equal values
        rows = rows.withColumn(f"_r_{c}", (F.rank().over(order) + through) / 2)
    out = rows.groupBy(by).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"), F.count(F.lit(1)).alias("n"))
    t = F.when(F.abs("rho") >= 1, F.lit(float("inf"))).otherwise(F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    return out.withColumn("p_value", F.when(F.col("n") > 2, t_p_value(t, F.col("n") - 2)))


def contrast(df: DataFrame, by: list[str], group: str, value: str, a, b) -> DataFrame:
    m = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return df.groupBy(by).agg((m(a) - m(b)).alias("difference"))


def bh_adjust(df: DataFrame, p: str, by: list[str] | None = None, out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg within each group. Without groups all p-values are ranked by a range partitioning, and no task has them all."""
    if not by:
        return _bh_over_all(df, p, out)
    part = Window.partitionBy(by)
    rows = df.withColumns({"_m": F.count(p).over(part), "_r": F.row_number().over(part.orderBy(p))})
    rows = rows.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    least = F.min("_q").over(part.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.least(F.lit(1.0), least)).drop("_m", "_r", "_q")


def _bh_over_all(df: DataFrame, p: str, out: str, block: int = 100_000) -> DataFrame:
    """The least of p * m / rank from a rank on: inside its block of ranks by a window, and over later blocks from one row for each block."""
    from .algebra import numbered

    known = numbered(df.where(F.col(p).isNotNull()), [p], "_r")
    m = known.count()
    rows = known.withColumns({"_q": F.col(p) * m / (F.col("_r") + 1), "_b": F.floor(F.col("_r") / block)})
    later = rows.groupBy("_b").agg(F.min("_q").alias("_q")).select("_b", F.min("_q").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    least = F.min("_q").over(Window.partitionBy("_b").orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    done = rows.join(F.broadcast(later), "_b").withColumn(out, F.least(F.lit(1.0), least, F.col("_later"))).select(*df.columns, out)
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def bonferroni(df: DataFrame, p: str, by: list[str], out: str = "p_adjusted") -> DataFrame:
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.count(p).over(Window.partitionBy(by))))


def stars(p: str, thresholds: tuple[float, ...] = (0.001, 0.01, 0.05)) -> Column:
    c, signs = F.lit("n.s."), ("***", "**", "*")
    for t, s in reversed(list(zip(thresholds, signs))):
        c = F.when(F.col(p) < t, s).otherwise(c)
    return c


def p_text(p: str) -> Column:
    return F.when(F.col(p) < 0.001, "< 0.001").otherwise(F.format_string("%.3f", F.col(p)))


def sbd_to_template(events: DataFrame, template: DataFrame, key: list[str], event: str, offset: str, values: str | list[str]) -> DataFrame:
    """``key, event, distance``: 1 less the largest normalised cross-correlation with the key's template over all lags; of several channels the mean of their distances.

    Offsets are whole numbers; a missing or null sample counts as 0. An event or template without length in some channel has a null distance; events whose key has no template are left out.
    A row is an event with its samples as arrays, and a batch of rows is correlated by one Fourier transform.
    """
    values = [values] if isinstance(values, str) else list(values)
    sample = F.struct(F.col(offset).cast("long").alias("at"), F.array(*[F.col(c).cast("double") for c in values]).alias("v"))
    whole = F.array_sort(F.collect_list(sample))
    rows = events.groupBy(*key, event).agg(whole.alias("_e")).join(template.groupBy(key).agg(whole.alias("_t")), key)

    def run(batches):
        for batch in batches:
            (x, nx), (y, ny) = (_placed(batch.column(batch.schema.get_field_index(c)), len(values)) for c in ("_e", "_t"))
            size = max(1, x.shape[2] + y.shape[2] - 1)
            cc = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)  # of each row and channel
            lag = np.arange(size)
            lag = np.where(lag < x.shape[2], lag, lag - size)
            own = (lag < nx[:, None]) & (lag > -ny[:, None])  # lags at which a row's samples meet
            cc = np.where(own[:, None], cc, -np.inf)
            norm = np.sqrt((x * x).sum(2) * (y * y).sum(2))
            with np.errstate(invalid="ignore", divide="ignore"):
                distance = (1 - cc.max(2) / norm).mean(1)
            fine = (norm > 0).all(1)
            kept = batch.select([c for c in batch.schema.names if c not in ("_e", "_t")])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(distance, mask=~fine)], names=[*kept.schema.names, "distance"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [*key, event]) + ", distance double")


def _placed(column: pa.Array, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x channels x samples of arrays of (place, values), from each row's first place on, zeros where there is none; and how far each row goes."""
    place, v = column.flatten().field("at").to_numpy(zero_copy_only=False), column.flatten().field("v").flatten().to_numpy(zero_copy_only=False)
    length = np.asarray(column.value_lengths())
    row = np.repeat(np.arange(len(column)), length)
    first = np.zeros(len(column), dtype=np.int64)
    first[length > 0] = place[(np.cumsum(length) - length)[length > 0]]
    at = (place - first[row]).astype(np.int64)
    out = np.zeros((len(column), channels, int(at.max(initial=-1)) + 1))
    out[row, :, at] = np.nan_to_num(v.astype(float).reshape(-1, channels))
    span = np.zeros(len(column), dtype=np.int64)
    np.maximum.at(span, row, at + 1)
    return out, span


def flag_similar(distances: DataFrame, key: list[str], pre: Column, q: float = 0.5) -> DataFrame:
    """``threshold``: the key's quantile of distances where ``pre`` holds; ``similar`` up to it."""
    thr = distances.where(pre).groupBy(key).agg(F.percentile("distance", F.lit(q)).alias("threshold"))
    return distances.join(thr, key).withColumn("similar", F.col("distance") <= F.col("threshold"))


def grid_count(points: DataFrame, key: list[str], x: str = "x", y: str = "y", size: float = 300) -> DataFrame:
    return points.groupBy(*key, F.floor(F.col(x) / size).alias("ci"), (-F.ceil(F.col(y) / size)).alias("rj")).agg(F.count(F.lit(1)).alias("n"))


def rotate_ccw(points: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(x, y) to (-y, x) about the centre of the key's bounding box."""
    w = Window.partitionBy(key)
    cx, cy = (F.min(x).over(w) + F.max(x).over(w)) / 2, (F.min(y).over(w) + F.max(y).over(w)) / 2
    rows = points.withColumns({"_cx": cx, "_cy": cy})
    return rows.withColumns({x: F.col("_cx") - (F.col(y) - F.col("_cy")), y: F.col("_cy") + (F.col(x) - F.col("_cx"))}).drop("_cx", "_cy")


def mirror_y(points: DataFrame, key: list[str], size: float = 300, y: str = "y") -> DataFrame:
    """Upside down about the centre of the grid cells that the key's points span, so the grid stays the same."""
    w = Window.partitionBy(key)
    row = -F.ceil(F.col(y) / size)
    middle = -size * (F.min(row).over(w) + F.max(row).over(w) + 1) / 2
    return points.withColumn("_middle", middle).withColumn(y, F.col("_middle") + (F.col("_middle") - F.col(y))).drop("_middle")


def mean_absent_zero(df: DataFrame, unit: str, by: list[str], cell: list[str], value: str, out: str = "mean") -> DataFrame:
    """Mean over the units of each group, where a unit without a cell counts as 0."""
    n = df.groupBy(by).agg(F.countDistinct(unit).alias("_n")) if by else df.agg(F.countDistinct(unit).alias("_n"))
    sums = df.groupBy(*by, *cell).agg(F.sum(value).alias("_s"))
    joined = sums.join(n, by) if by else sums.crossJoin(F.broadcast(n))
    return joined.select(*by, *cell, (F.col("_s") / F.col("_n")).alias(out))


def bounds(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))], F.max(value).alias("max_value"))
