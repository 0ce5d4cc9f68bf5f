"""Encoding models: regressors on a frame clock, lagged design matrices, and cross-validated ridge from per-fold Gram matrices.

Design columns are long: ``key, frame, col, x``. A fit is one pass that sums, per fold, the products of a row's columns and
targets; every alpha and fold is solved from these sums, whose size is the model's and not the recording's. Lagged designs need no lagged rows: ``lagged_ridge_cv``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .algebra import numbered
from .gram import fold_grams, lagged_grams, stacked
from .signal import interp, searchsorted


def event_regressor(events: DataFrame, samples: DataFrame, key: list[str], event_t: str, sample_t: str, frame: str, which: str = "onset", end_t: str | None = None) -> DataFrame:
    """``key, frame, x``: 1 at the first frame at or after an onset, an offset or both, else 0."""
    times = []
    if which in ("onset", "both"):
        times.append(events.select(*key, F.col(event_t).alias("_e")))
    if which in ("offset", "both"):
        times.append(events.select(*key, F.col(end_t).alias("_e")))
    rows = times[0] if len(times) == 1 else times[0].unionByName(times[1])
    hit = searchsorted(rows, samples, key, "_e", sample_t, frame, out="_f").select(*key, F.col("_f").alias(frame)).distinct().withColumn("_x", F.lit(1.0))
    return samples.select(*key, frame).join(hit, [*key, frame], "left").select(*key, frame, F.coalesce("_x", F.lit(0.0)).alias("x"))


def analog_regressor(signal: DataFrame, samples: DataFrame, key: list[str], t: str, value: str, frame: str, zscore: bool = False) -> DataFrame:
    """``key, frame, x``: the signal interpolated to the frame clock, standardised if asked."""
    out = interp(samples.select(*key, t, frame), signal, key, t, value, out="x").select(*key, frame, "x")
    return standardise(out, key, "x") if zscore else out


def standardise(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Less the mean, over the population deviation; a constant column becomes 0. Rows whose ``by`` is null are left out.

    Moments are combined inside tasks first, so a frequent key costs no more than another.
    """
    m = df.groupBy(by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_d"))
    rows = df.join(m, by) if by else df.crossJoin(F.broadcast(m))
    return rows.withColumn(column, (F.col(column) - F.col("_m")) / F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d"))).drop("_m", "_d")


def shuffle_rows(df: DataFrame, key: list[str], frame: str, value: str, seed: int = 42) -> DataFrame:
    """The values of each key in another, repeatable order."""
    order = Window.partitionBy(key).orderBy(frame)
    mixed = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), frame), frame)
    rows = df.withColumns({"_i": F.row_number().over(order), "_j": F.row_number().over(mixed)})
    return rows.select(*key, frame, "_i").join(rows.select(*key, F.col("_j").alias("_i"), value), [*key, "_i"]).drop("_i")


def lag_expand(df: DataFrame, key: list[str], frame: str, value: str, lags: list[int], wrap: bool = True) -> DataFrame:
    """``key, frame, lag, x``: the value ``lag`` frames on, around the end of the recording (``wrap``) or 0 past it.

    Frames count from 0 without gaps.
    """
    rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("lag", F.explode(F.lit(lags)))
    to = F.col(frame) - F.col("lag")
    if wrap:
        return rows.select(*key, F.pmod(to, F.col("_n")).alias(frame), "lag", F.col(value).alias("x"))
    shifted = rows.select(*key, to.alias(frame), "lag", F.col(value).alias("x"))
    every = rows.select(*key, frame, "lag")
    return every.join(shifted, [*key, frame, "lag"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def gauss_expand(df: DataFrame, key: list[str], frame: str, value: str, sigma: float, shifts: list[int]) -> DataFrame:
    """``key, frame, lag, x``: the value smoothed with a normalised Gaussian kernel centred on each shift; 0 past the ends.

    The kernel reaches ``max(abs(shifts)) + int(sigma + 5)`` frames each way and is rolled within that reach.
    """
    r = max(abs(k) for k in shifts) + int(sigma + 5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / int(sigma)) ** 2)
    g /= g.sum()
    taps = [(int(k), (i + k + r) % (2 * r + 1) - r, float(g[i + r])) for k in shifts for i in range(-r, r + 1)]
    tap = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.lit(j).alias("j"), F.lit(c).alias("c")) for k, j, c in taps])).alias("_t")
    spread = df.where(F.col(value) != 0).select(*key, frame, value, tap).withColumn("lag", F.col("_t.lag"))
    sums = spread.groupBy(*key, (F.col(frame) + F.col("_t.j")).alias(frame), "lag").agg(F.sum(F.col(value) * F.col("_t.c")).alias("x"))
    every = df.select(*key, frame, F.explode(F.lit(shifts)).alias("lag"))
    return every.join(sums, [*key, frame, "lag"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


def design_matrix(regressors: dict[str, DataFrame], key: list[str], frame: str) -> DataFrame:
    """``key, frame, reg, lag, x`` standardised per column; regressors that are 0 everywhere in a key are left out."""
    out = None
    for name, df in regressors.items():
        own = df.select(*key, frame, F.lit(name).alias("reg"), F.col("lag").cast("int").alias("lag") if "lag" in df.columns else F.lit(0).alias("lag"), F.col("x").cast("double").alias("x"))
        out = own if out is None else out.unionByName(own)
    some = F.max(F.abs("x")).over(Window.partitionBy(*key, "reg")) > 0
    return standardise(out.withColumn("_some", some).where("_some").drop("_some"), [*key, "reg", "lag"], "x")


def model_table(regressors: DataFrame, name: str, shuffled: list[str] = (), n_alphas: int = 50, n_folds: int = 5, low: float = 0.0, high: float = 7.0) -> DataFrame:
    """One row per regressor (``reg_name, first_lag, last_lag``) of a model: lags, whether shuffled (``["all"]``: each), folds and log-spaced alphas."""
    alphas = F.array(*[F.lit(float(10**x)) for x in np.linspace(low, high, n_alphas)])
    mixed = F.lit(True) if list(shuffled) == ["all"] else F.col("reg_name").isin(list(shuffled))
    return regressors.select(F.lit(name).alias("model_name"), "reg_name", mixed.alias("shuffle"), F.sequence("first_lag", "last_lag").alias("lag_frames"), F.lit(n_folds).alias("n_folds"), alphas.alias("alphas"))


def reduced_models(full: DataFrame) -> DataFrame:
    """For each regressor a model in which it alone is shuffled."""
    names = full.select(F.col("reg_name").alias("left_out"))
    rows = full.crossJoin(F.broadcast(names))
    return rows.withColumns({"model_name": F.concat("model_name", F.lit("_without_"), "left_out"), "shuffle": F.col("reg_name") == F.col("left_out")}).drop("left_out")


def kfold(df: DataFrame, key: list[str], order: list, k: int, out: str = "fold") -> DataFrame:
    """Contiguous folds in order; the first n mod k are one longer."""
    if key:
        w = Window.partitionBy(key)
        rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    else:
        rows = numbered(df, order, "_i").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    long = r * (q + 1)
    fold = F.when(F.col("_i") < long, F.floor(F.col("_i") / (q + 1))).otherwise(r + F.floor((F.col("_i") - long) / F.greatest(q, F.lit(1))))
    return rows.withColumn(out, fold.cast("int")).drop("_i", "_n")


def ridge_cv(rows: DataFrame, p: int, q: int, alphas: list[float], fit_intercept: bool = True) -> dict:
    """Ridge of arrays ``y`` on ``x`` by ``fold``: see ``ridge_of_grams``."""
    return ridge_of_grams(fold_grams(rows, p, q), p, alphas, fit_intercept)


def lagged_ridge_cv(rows: DataFrame, key: list[str], frame: str, x: str, y: str, lags: list[list[int]], folds: int, alphas: list[float], fit_intercept: bool = True) -> dict:
    """Ridge of arrays ``y`` on circularly lagged signals ``x`` over contiguous folds of a recording, without lagged rows; ``lags`` of each signal give the columns in their order."""
    grams, p, _ = lagged_grams(rows, key, frame, x, y, lags, folds)
    return ridge_of_grams(grams, p, alphas, fit_intercept)


def ridge_of_grams(grams: dict[int, np.ndarray], p: int, alphas: list[float], fit_intercept: bool = True) -> dict:
    """Ridge from sums of products of [1, x, y] in each fold, ``p`` columns x: the alpha of the best mean test R2, its scores, and a fit per fold.

    Returns ``alpha, scores`` (alpha x fold), ``coefficients`` (fold -> p x q) and ``intercepts``. R2 is variance-weighted.
    """
    total = sum(grams.values())
    scores, fits = np.zeros((len(alphas), len(grams))), {}
    for k, (f, test) in enumerate(sorted(grams.items())):
        train = total - test
        n, q = train[0, 0], len(test) - 1 - p
        mx, my = (train[0, 1 : 1 + p] / n, train[0, 1 + p :] / n) if fit_intercept else (np.zeros(p), np.zeros(q))
        xx = train[1 : 1 + p, 1 : 1 + p] - n * np.outer(mx, mx)
        xy = train[1 : 1 + p, 1 + p :] - n * np.outer(mx, my)
        w, v = np.linalg.eigh(xx)
        half = v.T @ xy
        m = test[0, 0]
        sx, sy = test[0, 1 : 1 + p], test[0, 1 + p :]
        txx, txy, tyy = test[1 : 1 + p, 1 : 1 + p], test[1 : 1 + p, 1 + p :], np.diag(test)[1 + p :]
        sst = (tyy - sy * sy / m).sum()
        for a, alpha in enumerate(alphas):
            b = v @ (half / (w + alpha)[:, None])
            c = my - mx @ b
            sse = (tyy - 2 * (b * txy).sum(0) - 2 * c * sy + (b * (txx @ b)).sum(0) + 2 * c * (sx @ b) + m * c * c).sum()
            scores[a, k] = 1 - sse / sst if sst > 0 else 0.0
            fits[f, a] = (b, c)
    best = int(scores.mean(1).argmax())
    folds = sorted(grams)
    return {"alpha": alphas[best], "scores": scores, "r2": scores[best], "coefficients": {f: fits[f, best][0] for f in folds}, "intercepts": {f: fits[f, best][1] for f in folds}}


def predict(rows: DataFrame, fitted: dict, subset: list[int] | None = None, include_intercept: bool = True) -> DataFrame:
    """Out-of-fold predictions (array ``predicted``) from all design columns or some of them."""
    out = parts_of_prediction(rows, fitted, {"predicted": list(range(len(next(iter(fitted["coefficients"].values()))))) if subset is None else subset})
    if include_intercept:
        out = out.withColumn("predicted", F.zip_with("predicted", "intercept", lambda a, b: a + b))
    return out.drop("intercept", "total")


def parts_of_prediction(rows: DataFrame, fitted: dict, groups: dict[str, list[int]], y: str | None = None, baseline: str | None = None) -> DataFrame:
    """``rows`` with out-of-fold predictions as arrays: one for the design columns of each group, ``intercept``, and their ``total`` over all columns; with ``y`` also ``true``.

    ``baseline``: the outputs less their baseline at rest; what it takes away from ``y`` is then part of ``intercept`` and ``total``. Rows of a fold that the fit does not know have null parts.
    """
    b, c = fitted["coefficients"], fitted["intercepts"]
    names = [*groups, "intercept", "total"]

    def run(batches):
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            folds, x = np.array(table.column("fold").to_pylist(), dtype=object), stacked(table.column("x"))
            made = {n: [None] * batch.num_rows for n in names}
            shift = stacked(table.column(baseline)) - stacked(table.column(y)) if baseline else np.zeros((batch.num_rows, 1))
            for f in b:
                at = np.flatnonzero(folds == f)
                if not len(at):
                    continue
                start = shift[at] + c[f]
                found = {n: x[at][:, own] @ b[f][own] for n, own in groups.items()} | {"intercept": start, "total": x[at] @ b[f] + start}
                for n, v in found.items():
                    for i, row in zip(at, v):
                        made[n][i] = row
            for n in names:
                table = table.append_column(n, pa.array(made[n], pa.list_(pa.float64())))
            yield from table.to_batches()

    out = rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + "".join(f", `{n}` array<double>" for n in names))
    return out.withColumn("true", F.col(y)) if y else out


def long_predict(design: DataFrame, coefficients: DataFrame, by: list[str], frame: str) -> DataFrame:
    """Sum of ``x * coef`` over the design's columns (``col``), per frame."""
    return design.join(F.broadcast(coefficients), [*by, "col"]).groupBy(*by, frame).agg(F.sum(F.col("x") * F.col("coef")).alias("predicted"))


def weighted_r2(df: DataFrame, by: list[str], output: str, truth: str, pred: str) -> DataFrame:
    """1 - (sum of squared errors) / (sum of squared deviations), both over all outputs."""
    per = df.groupBy(*by, output).agg(F.sum((F.col(truth) - F.col(pred)) ** 2).alias("sse"), F.var_pop(truth).alias("v"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg((1 - F.sum("sse") / F.sum(F.col("v") * F.col("n"))).alias("r2")) if by else per.agg((1 - F.sum("sse") / F.sum(F.col("v") * F.col("n"))).alias("r2"))


def r2_map(pairs: DataFrame, u: DataFrame, k: int) -> DataFrame:
    """``pixel, r2``: squared correlation per pixel of truth and prediction, from covariances of k components (arrays ``truth, pred``)."""
    m = pairs.select(F.concat("truth", "pred").alias("z")).agg(F.count(F.lit(1)), *[F.avg(F.col("z")[i]) for i in range(2 * k)]).first()
    from .imaging import gram

    n, mean = m[0], np.array(m[1:], dtype=float)
    cov = gram(pairs.select(F.concat("truth", "pred").alias("z")), "z", 2 * k) / max(n, 1) - np.outer(mean, mean)
    tt, pp, tp = cov[:k, :k], cov[k:, k:], cov[:k, k:]

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["u"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, k))
            q = lambda a: np.einsum("ni,ij,nj->n", x, a, x)
            pdf = pdf[["pixel"]].copy()
            d = q(tt) * q(pp)
            pdf["r2"] = np.where(d > 0, q(tp) ** 2 / np.where(d > 0, d, 1), 0.0)
            yield pdf

    return u.select("pixel", "u").mapInPandas(run, "pixel long, r2 double")


def fold_average(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(value))


def unique_contribution(full: DataFrame, reduced: DataFrame, on: list[str], value: str = "r2") -> DataFrame:
    return full.select(*on, F.col(value).alias("_f")).join(reduced, on).withColumn("delta_r2", F.col("_f") - F.col(value)).drop("_f")
