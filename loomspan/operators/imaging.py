"""Image stacks and matrices as Spark jobs.

Long form is one row per (key, frame, pixel); kernels work on one row per frame (pixels as an array) or per pixel (series as an
array). The change from frames to pixels is the one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialised
from . import kernels
from .chunks import with_key
from .gram import packed, partial_sums, stacked, tree_sum, unpacked


def deinterleave(frames: DataFrame, frame: str = "frame") -> DataFrame:
    return frames.withColumns({"channel": F.col(frame) % 2, frame: F.floor(F.col(frame) / 2)})


def template(pixels: DataFrame, key: list[str], frame: str, pixel: str, value: str, first: int = 100) -> DataFrame:
    return pixels.where(F.col(frame) < first).groupBy(*key, pixel).agg(F.avg(value).alias("template"))


def saturation_mask(pixels: DataFrame, key: list[str], frame: str, pixel: str, value: str, first: int = 1200, limit: float = 65500) -> DataFrame:
    return pixels.where(F.col(frame) < first).groupBy(*key, pixel).agg((F.max(value) > limit).alias("saturated"))


def partial_frames(pixels: DataFrame, frame: str, n_frames: str, edge: int = 600) -> DataFrame:
    """The first and last ``edge`` frames; the filter reaches the scan."""
    return pixels.where((F.col(frame) < edge) | (F.col(frame) >= 2 * F.col(n_frames) - edge))


def frame_shifts(frames: DataFrame, templates: DataFrame, key: list[str], shape: tuple[int, int], upsample: int = 20) -> DataFrame:
    """``key, frame, dx, dy``: shift of each frame (array ``pixels``) against its key's template (array ``template``)."""
    joined = frames.join(templates.select(*key, "template"), key)

    def run(batches):
        for pdf in batches:
            s = [kernels.phase_shift(np.reshape(t, shape), np.reshape(p, shape), upsample) for t, p in zip(pdf["template"], pdf["pixels"])]
            pdf = pdf[[*key, "frame"]].copy()
            pdf["dx"], pdf["dy"] = [a for a, _ in s], [b for _, b in s]
            yield pdf

    types = dict(frames.dtypes)
    return joined.select(*key, "frame", "pixels", "template").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*key, "frame"]) + ", dx double, dy double")


def shift_summary(shifts: DataFrame, by: list[str]) -> DataFrame:
    out = []
    for a in ("x", "y"):
        out += [F.max(F.abs(f"d{a}")).alias(f"max_{a}"), F.avg(f"d{a}").alias(f"mean_{a}"), F.stddev_pop(f"d{a}").alias(f"std_{a}")]
    return shifts.groupBy(by).agg(*out)


def channel_correlation(shifts: DataFrame, by: list[str], frame: str, method: str = "phase") -> DataFrame:
    """Correlation of the two channels' shifts; 0 where undefined, 1 if no method was used."""
    if method == "none":
        return shifts.select(by).distinct().withColumns({"r_x": F.lit(1.0), "r_y": F.lit(1.0)})
    at = lambda c, k: F.max(F.when(F.col("channel") == k, F.col(c)))
    wide = shifts.groupBy(*by, frame).agg(at("dx", 0).alias("x0"), at("dx", 1).alias("x1"), at("dy", 0).alias("y0"), at("dy", 1).alias("y1"))
    r = lambda a, b: F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))
    return wide.groupBy(by).agg(r("x0", "x1").alias("r_x"), r("y0", "y1").alias("r_y"))


def low_motion_sessions(summary: DataFrame, done: DataFrame, key: list[str], max_shift: float = 0.5, max_std: float = 0.1, parts: int = 4) -> DataFrame:
    """Keys all of whose ``parts`` rows meet the limits and that are not in ``done``."""
    fine = (F.greatest("max_x", "max_y") <= max_shift) & (F.greatest("std_x", "std_y") <= max_std)
    return summary.groupBy(key).agg(F.count_if(fine).alias("_n")).where(F.col("_n") == parts).drop("_n").join(done.select(key), key, "left_anti")


def shift_to_affine(dx: str, dy: str) -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, zero, F.col(dx).cast("double"), zero, one, F.col(dy).cast("double"))


def affine_to_shift(m: str) -> tuple[Column, Column]:
    return F.col(m)[2], F.col(m)[5]


def spatial_process(frames: DataFrame, key: list[str], shape: tuple[int, int], sigma: float, new_shape: tuple[int, int]) -> DataFrame:
    """Two affine maps (``motion``, ``session``: six numbers), blur and area resize of each frame (array ``pixels``)."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, a, b in zip(pdf["pixels"], pdf["motion"], pdf["session"]):
                img = kernels.warp(kernels.warp(np.reshape(p, shape), np.reshape(a, (2, 3))), np.reshape(b, (2, 3)))
                out.append(kernels.area_mean(kernels.blur(img, sigma, 5), *new_shape).ravel())
            pdf = pdf[[*key, "frame"]].copy()
            pdf["pixels"] = out
            yield pdf

    types = dict(frames.dtypes)
    return frames.select(*key, "frame", "pixels", "motion", "session").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*key, "frame"]) + ", pixels array<double>")


def tiled(frames: DataFrame, key: list[str], tile: int = 64) -> DataFrame:
    """``key, frame, tile, values``: the array ``pixels`` of each frame cut into arrays of ``tile`` pixels; an empty frame has none."""
    size = F.size("pixels")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(size / tile).cast("int") - 1), lambda k: F.slice("pixels", k * tile + 1, tile))
    return frames.where(size > 0).select(*key, "frame", F.posexplode(cut).alias("tile", "values"))


def frames_to_pixels(frames: DataFrame, key: list[str], tile: int = 64) -> DataFrame:
    """Rows per pixel, ``series`` in frame order, from rows per frame (array ``pixels``).

    Tiles of frames are what is sent, so the shuffle has frames x tiles rows and not one for each pixel of each frame. A task turns a tile of all frames at a time.
    """
    whole = tiled(frames, key, tile).groupBy(*key, "tile").agg(F.array_sort(F.collect_list(F.struct("frame", "values"))).alias("_s"))
    size = F.array_max(F.transform("_s", lambda x: F.size(x["values"])))
    turned = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.transform(F.filter("_s", lambda x: F.size(x["values"]) > k), lambda x: x["values"][k]))
    return whole.select(*key, "tile", F.posexplode(turned).alias("_k", "series")).select(*key, (F.col("tile") * tile + F.col("_k")).alias("pixel"), "series")


def temporal_process(pixels: DataFrame, key: list[str], fs: float = 20.0, fcutoff: float | None = 0.1, sigma: float | None = 1.0, order: int = 2, padlen: int | None = None) -> DataFrame:
    """High-pass and Gaussian smoothing of each pixel's ``series``, its mean kept; either is left out for None. All series of a length in a batch are filtered together."""

    def run(batches):
        for pdf in batches:
            out, length = [None] * len(pdf), np.array([len(v) for v in pdf["series"]], dtype=int)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                x = np.stack([np.asarray(pdf["series"].iloc[i], dtype=float) for i in at])
                mean = x.mean(1, keepdims=True) if n else x
                f = kernels.highpass(x - mean, fs, fcutoff, order, padlen) if fcutoff is not None else x - mean
                for i, v, m in zip(at, f, mean):
                    out[i] = (kernels.gauss(v, sigma) if sigma and n else v) + m
            pdf["series"] = out
            yield pdf

    types = dict(pixels.dtypes)
    return pixels.select(*key, "pixel", "series").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*key, "pixel"]) + ", series array<double>")


def regress_out(df: DataFrame, key: list[str], y: str, refs: list[str], out: str = "residual") -> DataFrame:
    """Residuals per key of least squares of ``y`` on one or two references and a constant, from moments in one pass."""
    n = Window.partitionBy(key)
    mean = {f"_m{k}": F.avg(c).over(n) for k, c in enumerate([y, *refs])}
    rows = df.withColumns(mean)
    c = [F.col(v) - F.col(f"_m{k}") for k, v in enumerate([y, *refs])]
    s = lambda a, b: F.sum(c[a] * c[b]).over(n)
    if len(refs) == 1:
        rows = rows.withColumn("_b1", F.try_divide(s(0, 1), s(1, 1)))
        fit = F.coalesce("_b1", F.lit(0.0)) * c[1]
    else:
        rows = rows.withColumns({"_11": s(1, 1), "_22": s(2, 2), "_12": s(1, 2), "_01": s(0, 1), "_02": s(0, 2)})
        det = F.col("_11") * F.col("_22") - F.col("_12") * F.col("_12")
        rows = rows.withColumns({"_b1": F.try_divide(F.col("_01") * F.col("_22") - F.col("_02") * F.col("_12"), det), "_b2": F.try_divide(F.col("_02") * F.col("_11") - F.col("_01") * F.col("_12"), det)})
        fit = F.coalesce("_b1", F.lit(0.0)) * c[1] + F.coalesce("_b2", F.lit(0.0)) * c[2]
    return rows.withColumn(out, c[0] - fit).select(*df.columns, out)


def background(pixels: DataFrame, mask: DataFrame, key: list[str], frame: str, pixel: str, value: str) -> DataFrame:
    """Mean of the pixels outside the mask, per frame."""
    return pixels.join(mask.where("valid").select(pixel), pixel, "left_anti").groupBy(*key, frame).agg(F.avg(value).alias("background"))


def delta_f(pixels: DataFrame, mask: DataFrame, key: list[str], pixel: str, residual: str, value: str, out: str = "dff") -> DataFrame:
    """Residual over the pixel's mean; undefined values and masked pixels are 0."""
    rows = pixels.join(mask.select(pixel, "valid"), pixel, "left").withColumn("_m", F.avg(value).over(Window.partitionBy(*key, pixel)))
    x = F.try_divide(F.col(residual), F.col("_m"))
    fine = F.coalesce(F.col("valid"), F.lit(False)) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.withColumn(out, F.when(fine, x).otherwise(F.lit(0.0))).drop("_m", "valid")


def morphology(mask: DataFrame, width: int, height: int, k: int, dilate: bool = True, times: int = 1) -> DataFrame:
    """Dilate or erode ``(pixel, valid)`` with a k x k square; pixels outside the image count as 0."""
    r = k // 2
    for _ in range(times):
        x, y = F.col("pixel") % width, F.floor(F.col("pixel") / width)
        near = mask.where("valid").withColumns({"_x": x, "_y": y}).withColumn("_d", F.explode(F.sequence(F.lit(-r), F.lit(k - 1 - r)))).withColumn("_e", F.explode(F.sequence(F.lit(-r), F.lit(k - 1 - r))))
        near = near.withColumns({"_x": F.col("_x") + F.col("_d"), "_y": F.col("_y") + F.col("_e")}).where(f"_x between 0 and {width - 1} and _y between 0 and {height - 1}")
        hits = near.groupBy((F.col("_y") * width + F.col("_x")).alias("pixel")).agg(F.count(F.lit(1)).alias("_n"))
        mask = mask.select("pixel").join(hits, "pixel", "left").select("pixel", (F.coalesce("_n", F.lit(0)) >= (1 if dilate else k * k)).alias("valid"))
    return mask


def summed(rows: DataFrame, array: str, shape: tuple[int, ...], of) -> np.ndarray:
    """The sum over blocks of rows of an array of fixed shape: tasks send packed blocks of partial sums, which are added in a tree."""
    total = tree_sum(partial_sums(rows.select(array), lambda batch: {0: of(stacked(batch.column(0))).ravel()}))
    return total[0].reshape(shape) if total else np.zeros(shape)


def gram(rows: DataFrame, array: str, n: int) -> np.ndarray:
    """The n x n matrix of summed products of an array column; n is the fixed width. Its upper half is what is sent."""
    return unpacked(summed(rows, array, (n * (n + 1) // 2,), lambda x: packed(x.T @ x)), n)


def leading_axes(rows: DataFrame, array: str, n: int, k: int, centred: bool = False, exact: int = 1024, extra: int = 10, passes: int = 8) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """The ``k`` largest eigenvalues and vectors of the summed products, the number of rows and their mean (both 0 unless ``centred``).

    Up to a width of ``exact`` all n x n products are summed. A wider column takes ``passes`` of subspace iteration with ``k + extra`` vectors,
    so that a task sums n x (k + extra) cells and never n x n.
    """
    count, mean = 0.0, np.zeros(n)
    if centred:
        sums = summed(rows, array, (2, n), lambda x: np.stack([x.sum(0), np.full(n, float(len(x)))]))
        count, mean = sums[1, 0], sums[0] / max(sums[1, 0], 1)
    if n <= exact:
        values, vectors = np.linalg.eigh(gram(rows, array, n) - count * np.outer(mean, mean))
    else:
        width = min(n, k + extra)
        product = np.random.default_rng(0).normal(size=(n, width))
        for _ in range(passes):
            q = np.linalg.qr(product)[0]
            product = summed(rows, array, (n, width), lambda x, q=q: x.T @ (x @ q)) - count * np.outer(mean, mean @ q)
        values, inner = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        vectors = q @ inner
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order], count, mean


def truncated_svd(rows: DataFrame, key: str, array: str, n: int, k: int, **how) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(``key, u``), singular values and right vectors of a tall matrix of width n; ``how`` goes to ``leading_axes``."""
    values, v, _, _ = leading_axes(rows, array, n, k, **how)
    s = np.sqrt(np.maximum(values, 0))

    def project(batches):
        for pdf in batches:
            x = np.stack(pdf[array].to_numpy()).astype(float) if len(pdf) else np.zeros((0, n))
            out = pdf[[key]].copy()
            out["u"] = list(x @ v / np.where(s > 0, s, 1))
            yield out

    return rows.select(key, array).mapInPandas(project, f"{key} {dict(rows.dtypes)[key]}, u array<double>"), s, v


def explained_variance(rows: DataFrame, array: str, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Share of each component: the variance of ``s * v`` over the array's places, of the summed variances of all rows."""
    fold = lambda f: F.aggregate(F.col(array), F.lit(0.0), lambda t, x: t + f(x.cast("double")))
    mean = fold(lambda x: x) / F.size(array)
    total = rows.agg(F.sum(fold(lambda x: x * x) / F.size(array) - mean * mean)).first()[0]
    return (v * s).var(0) / total if total else np.zeros(len(s))


def reconstruct(u: DataFrame, s: DataFrame, on: str = "component") -> DataFrame:
    """``pixel, frame, value``: sum over components of ``u * s`` (long form). ``u``, which is as large as an image for each component, goes to all tasks, tile by tile; a frame's numbers meet once and no product is shuffled."""
    of = lambda df, key, v: df.where(F.col(on).isNotNull()).groupBy(key, on).agg(F.sum(v).alias(v)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(on, v))).alias(v))
    pairs = of(s, "frame", "s").crossJoin(F.broadcast(of(u, "pixel", "u")))
    both = F.filter(F.map_keys("u"), lambda c: F.map_contains_key("s", c))
    add = lambda t, p: F.when(p.isNull(), t).otherwise(F.coalesce(t, F.lit(0.0)) + p)
    value = F.aggregate(F.transform(both, lambda c: F.col("u")[c] * F.col("s")[c]), F.lit(None).cast("double"), add)
    return pairs.where(F.size(both) > 0).select("pixel", "frame", value.alias("value"))


def baseline_still(pixels: DataFrame, still: DataFrame, key: list[str], frame: str, pixel: str, value: str) -> DataFrame:
    """Values less the pixel's median over still frames."""
    base = pixels.join(still, [*key, frame], "left_semi").groupBy(*key, pixel).agg(F.median(value).alias("_base"))
    return pixels.join(base, [*key, pixel], "left").withColumn(value, F.col(value) - F.coalesce("_base", F.lit(0.0))).drop("_base")


def _apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, where both sides of a cogroup come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def baseline_components(components: DataFrame, u: DataFrame, still: DataFrame, key: list[str], mask: DataFrame | None = None, tile: int = 1024, frames: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Components less the baseline at rest, projected anew: (``key, frame, sv``) and the baseline (``key, pixel, baseline``).

    ``components``: ``key, frame, sv`` (array of k numbers). ``u``: ``key, pixel, u`` (array of k). The stack is ``u @ sv``; its baseline is each pixel's median over the frames of ``still`` (``key, frame``); the difference is 0 outside ``mask``
    (``pixel, valid``; without one all pixels are valid) and is projected on ``u``. As that is linear, ``u' M (u sv - b) = (u' M u) sv - u' M b``, frames that are not at rest never become images: tiles of pixels give the median and
    their share of both matrices, which are summed over tiles. A session without a frame at rest, or a frame without ``sv``, has no row; not-a-number counts as 0 in ``u``.
    """
    known = ", ".join(f"`{k}` {dict(components.dtypes)[k]}" for k in key)
    pixels = u.select(*key, "pixel", "u") if mask is None else u.join(mask.select("pixel", "valid"), "pixel", "left").select(*key, "pixel", F.when(F.coalesce("valid", F.lit(False)), F.col("u")).alias("u"), F.col("u").alias("_whole"))
    pixels = (pixels.withColumn("_whole", F.col("u")) if mask is None else pixels)
    # pixels are dealt by number, not by place: a session's frames go to each of its parts, so their number is kept low
    sizes, by = u.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / max(tile, 1024)).alias("_parts")), [*key, "_tile"]
    pixels = (pixels.join(sizes, key) if key else pixels.crossJoin(F.broadcast(sizes))).withColumn("_tile", F.pmod(F.xxhash64("pixel"), F.col("_parts"))).drop("_parts")
    tiles = sizes.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_tile"))
    rest = components.where(F.col("sv").isNotNull()).join(still.select(*key, "frame").distinct(), [*key, "frame"], "left_semi")
    rest = (rest.join(tiles, key) if key else rest.crossJoin(F.broadcast(tiles))).select(*by, "sv")

    def medians(own: pa.Table, sv: pa.Table) -> pa.Table:
        made = {"pixel": pa.array([], pa.int64()), "baseline": pa.array([], pa.float64()), "a": pa.array([], pa.list_(pa.float64())), "b": pa.array([], pa.list_(pa.float64()))}
        if not own.num_rows or not sv.num_rows:
            return pa.table({**{k: own.column(k).slice(0, 0) for k in by}, **made})
        whole = np.nan_to_num(stacked(own.column("_whole")))
        rest, step = stacked(sv.column("sv")).T, max(1, min(tile, 4_000_000 // sv.num_rows))
        base = np.concatenate([np.median(whole[i : i + step] @ rest, axis=1) for i in range(0, len(whole), step)])
        kept = np.array([v.is_valid for v in own.column("u")])
        m, n = whole[kept], own.num_rows
        sums = lambda v: pa.array([v.ravel().tolist(), *[None] * (n - 1)], pa.list_(pa.float64()))
        return pa.table({**{k: own.column(k) for k in by}, "pixel": own.column("pixel").cast(pa.int64()), "baseline": pa.array(base), "a": sums(m.T @ m), "b": sums(m.T @ base[kept])})

    found = pixels.groupBy(by).cogroup(_apart(rest).groupBy(by)).applyInArrow(medians, (known + ", " if key else "") + "_tile long, pixel long, baseline double, a array<double>, b array<double>")
    found = materialised(found, "baselines")

    def add(table: pa.Table) -> pa.Table:
        return with_key(table, key, {c: stacked(table.column(c)).sum(0) for c in ("a", "b")})

    shares = found.where(F.col("a").isNotNull())
    sums = shares.groupBy(key).applyInArrow(add, (known + ", " if key else "") + "a array<double>, b array<double>")
    chunks = components.where(F.col("sv").isNotNull()).withColumn("_chunk", F.floor(F.col("frame") / frames))
    places = chunks.select(*key, "_chunk").distinct()
    wanted = places.join(sums, key) if key else places.crossJoin(F.broadcast(sums))

    def project(own: pa.Table, at: pa.Table) -> pa.Table:
        if not at.num_rows:
            return own.slice(0, 0).select([*key, "frame", "sv"])
        b = stacked(at.column("b"))[0]
        sv = stacked(own.column("sv")) @ stacked(at.column("a"))[0].reshape(len(b), len(b)).T - b
        return own.select([*key, "frame"]).append_column("sv", pa.array(list(sv), pa.list_(pa.float64())))

    by = [*key, "_chunk"]
    kind = dict(components.dtypes)["frame"]
    out = chunks.groupBy(by).cogroup(_apart(wanted).groupBy(by)).applyInArrow(project, (known + ", " if key else "") + f"frame {kind}, sv array<double>")
    return out, found.select(*key, "pixel", "baseline")


def rescale_affine(m: str, ratio: float) -> Column:
    return F.array(*[F.col(m)[k] * (ratio if k in (2, 5) else 1.0) for k in range(6)])


def apply_affine(m: str, x: str, y: str) -> tuple[Column, Column]:
    a = F.col(m)
    return a[0] * F.col(x) + a[1] * F.col(y) + a[2], a[3] * F.col(x) + a[4] * F.col(y) + a[5]


def invert_affine(m: str) -> Column:
    a = F.col(m)
    det = a[0] * a[4] - a[1] * a[3]
    return F.array(a[4] / det, -a[1] / det, (a[1] * a[5] - a[4] * a[2]) / det, -a[3] / det, a[0] / det, (a[3] * a[2] - a[0] * a[5]) / det)


def flip_x(x: str, width: int, when: Column) -> Column:
    return F.when(when, F.lit(width - 1) - F.col(x)).otherwise(F.col(x))


def roi_mean(pixels: DataFrame, rois: DataFrame, key: list[str], pixel: str, value: str, frame: str | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Mean over the valid pixels of each ROI, and their number; an empty ROI is null with 0 pixels."""
    members = rois if mask is None else rois.join(mask.where("valid").select(pixel), pixel, "left_semi")
    by = [*key, *([frame] if frame else [])]
    sums = pixels.join(members, pixel).groupBy("roi", *by).agg(F.avg(value).alias("mean"), F.count(pixel).alias("n_pixels"))
    every = pixels.select(by).distinct().crossJoin(F.broadcast(rois.select("roi").distinct())) if by else rois.select("roi").distinct()
    return every.join(sums, ["roi", *by], "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0)))


def split_roi(rois: DataFrame, predicate: Column, names: tuple[str, str]) -> DataFrame:
    """Each ROI in two: pixels where the predicate holds, and the others, with a suffix each."""
    return rois.withColumn("roi", F.concat("roi", F.lit("-"), F.when(predicate, names[0]).otherwise(names[1])))


def merge_rois(rois: DataFrame, mapping: dict[str, str]) -> DataFrame:
    name = F.col("roi")
    for old, new in mapping.items():
        name = F.when(F.col("roi") == old, new).otherwise(name)
    return rois.withColumn("roi", name).distinct()


def centre_of_mass(rois: DataFrame, width: int, pixel: str = "pixel", names: DataFrame | None = None) -> DataFrame:
    """``roi, x, y``. With ``names`` (``roi``) each of these regions has a row, of nulls where it has no pixel."""
    out = rois.groupBy("roi").agg(F.avg(F.col(pixel) % width).alias("x"), F.avg(F.floor(F.col(pixel) / width)).alias("y"))
    return out if names is None else names.join(out, "roi", "left")


def aligned_maps(maps: DataFrame, key: list[str], shape: tuple[int, int]) -> DataFrame:
    """Each map (array ``pixels``) moved by its ``affine`` and, where ``flip``, mirrored left to right."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, m, f in zip(pdf["pixels"], pdf["affine"], pdf["flip"]):
                img = kernels.warp(np.reshape(p, shape), np.reshape(m, (2, 3)))
                out.append((img[:, ::-1] if f else img).ravel())
            pdf = pdf[key].copy()
            pdf["pixels"] = out
            yield pdf

    types = dict(maps.dtypes)
    return maps.select(*key, "pixels", "affine", "flip").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in key) + ", pixels array<double>")


def principal_components(rows: DataFrame, key: str, array: str, n: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """(``key, pc``) of centred rows, from summed products; the largest entry of each axis is positive."""
    values, vectors, count, mean = leading_axes(rows, array, n, k, centred=True)
    axes = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])

    def project(batches):
        for pdf in batches:
            x = np.stack(pdf[array].to_numpy()).astype(float) if len(pdf) else np.zeros((0, n))
            out = pdf[[key]].copy()
            out["pc"] = list((x - mean) @ axes)
            yield out

    return rows.select(key, array).mapInPandas(project, f"{key} {dict(rows.dtypes)[key]}, pc array<double>"), values / max(count, 1)
