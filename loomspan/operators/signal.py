"""Event logs and time series in long form: one row per sample, keyed by recording, ordered by a column.

Every operator is a lazy DataFrame function. Order columns must be unique within a key (give a tie-breaker as well). A
window never spans keys, so work grows with the longest recording and not with the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: list[str], order: list):
    return Window.partitionBy(key).orderBy(*order)


def binarise(column: str, threshold: float = 0.5) -> Column:
    return F.col(column) > threshold


def trials_from_events(log: DataFrame, key: list[str], t: str, event: str, roles: dict[str, str], fail: str, auto: str, reward: str) -> DataFrame:
    """The i-th occurrences of the events of each role belong to trial i.

    ``roles`` maps the columns ``t_start, t_servo_in, t_cue`` to event names; the outcome is the i-th event of ``fail``, ``auto`` and
    ``reward`` together, and gives ``t_servo_out`` and the flags. ``t_end`` is the next start, or an ``End`` event for the
    last trial. Trials that lack a part are left out.
    """
    role = F.lit(None).cast("string")
    for column, name in roles.items():
        role = F.when(F.col(event) == name, column).otherwise(role)
    role = F.when(F.col(event).isin(fail, auto, reward), "t_servo_out").otherwise(role)
    rows = log.withColumn("_role", role)
    last = rows.where(F.col(event) == "End").groupBy(key).agg(F.max(t).alias("_end"))
    rows = rows.where(F.col("_role").isNotNull()).withColumn("trial_id", F.row_number().over(Window.partitionBy(*key, "_role").orderBy(t)) - 1)
    of = lambda r: F.max(F.when(F.col("_role") == r, F.col(t))).alias(r)
    out = rows.groupBy(*key, "trial_id").agg(*[of(r) for r in (*roles, "t_servo_out")], F.max(F.when(F.col("_role") == "t_servo_out", F.col(event))).alias("_outcome"))
    out = out.withColumn("t_end", F.lead("t_start").over(_w(key, ["trial_id"]))).join(last, key, "left")
    out = out.withColumn("t_end", F.coalesce("t_end", "_end"))
    whole = F.lit(True)
    for c in (*roles, "t_servo_out", "t_end"):
        whole = whole & F.col(c).isNotNull()
    return out.where(whole).select(*key, "trial_id", *roles, "t_servo_out", "t_end", (F.col("_outcome") == reward).alias("successful"), (F.col("_outcome") == auto).alias("autoreward"))


def unknown_events(log: DataFrame, event: str, known: list[str]) -> DataFrame:
    return log.where(~F.col(event).isin(known))


def runs(df: DataFrame, key: list[str], order: list, flag: str, drop_last: bool = False) -> DataFrame:
    """Rows where ``flag`` holds, with ``run_id`` from 1 for each connected run; ``drop_last`` leaves out the last run."""
    w = _w(key, order)
    on = F.coalesce(F.col(flag), F.lit(False))
    start = (on & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    out = df.withColumn("run_id", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(on)
    if drop_last:
        out = out.withColumn("_last", F.max("run_id").over(Window.partitionBy(key))).where("run_id < _last").drop("_last")
    return out


def run_times(runs_df: DataFrame, key: list[str], t: str) -> DataFrame:
    return runs_df.groupBy(*key, "run_id").agg(F.median(t).alias("t"), (F.max(t) - F.min(t)).alias("duration"))


def sampling_stats(df: DataFrame, key: list[str], t: str) -> DataFrame:
    """Median and population deviation of the step, and the mean rate."""
    steps = df.withColumn("_dt", F.col(t) - F.lag(t).over(_w(key, [t])))
    return steps.groupBy(key).agg(F.median("_dt").alias("dt_median"), F.stddev_pop("_dt").alias("dt_std"), (1 / F.avg("_dt")).alias("rate"))


def gaps(df: DataFrame, key: list[str], t: str, k: float = 1.5, fail: float = 2.5) -> DataFrame:
    """Rows before a step over ``k`` medians: ``key, t, dt, dt_median, too_long``."""
    rows = df.withColumn("dt", F.lead(t).over(_w(key, [t])) - F.col(t))
    rows = rows.withColumn("dt_median", F.median("dt").over(Window.partitionBy(key)))
    return rows.where(F.col("dt") > k * F.col("dt_median")).select(*key, t, "dt", "dt_median", (F.col("dt") > fail * F.col("dt_median")).alias("too_long"))


def fill_gaps(df: DataFrame, key: list[str], t: str, k: float = 1.5) -> DataFrame:
    """Stamps with one added, a median step on, in every gap."""
    added = gaps(df, key, t, k).select(*key, (F.col(t) + F.col("dt_median")).alias(t), F.lit(True).alias("added"))
    return df.select(*key, t, F.lit(False).alias("added")).unionByName(added)


def reconcile_clock(stamps: DataFrame, n_frames: DataFrame, key: list[str], t: str, max_pad: int = 3, tol: int = 5) -> DataFrame:
    """``key, channel, frame, t``: stamps of two interleaved channels from a clock that may run at twice the rate.

    If half the stamps are within ``tol`` of ``n_frames``, every second one is kept; up to ``max_pad`` missing ones are
    added at the tail; the second channel is half a step later. Recordings that still differ have no rows.
    """
    w = Window.partitionBy(key)
    rows = stamps.withColumns({"_i": F.row_number().over(_w(key, [t])) - 1, "_n": F.count(F.lit(1)).over(w)}).join(n_frames, key)
    rows = rows.withColumn("_step", F.lead(t).over(_w(key, [t])) - F.col(t)).withColumn("_dt", F.median("_step").over(w))
    twice = F.abs(F.floor(F.col("_n") / 2) - F.col("n_frames")) <= tol
    rows = rows.withColumn("_two", twice).where(~F.col("_two") | (F.col("_i") % 2 == 0))
    rows = rows.withColumns({"frame": F.when(F.col("_two"), (F.col("_i") / 2).cast("long")).otherwise(F.col("_i").cast("long")), "_dt": F.when(F.col("_two"), F.col("_dt") * 2).otherwise(F.col("_dt"))})
    ends = rows.groupBy(*key, "n_frames", "_dt").agg(F.max("frame").alias("_last"), F.max(t).alias("_t"))
    lost = F.col("n_frames") - 1 - F.col("_last")
    pads = ends.where((lost > 0) & (lost <= max_pad)).withColumn("_k", F.explode(F.sequence(F.lit(1), lost.cast("int"))))
    pads = pads.select(*key, (F.col("_last") + F.col("_k")).alias("frame"), (F.col("_t") + F.col("_k") * F.col("_dt")).alias(t), "_dt")
    good = ends.where((lost >= 0) & (lost <= max_pad)).select(key)
    first = rows.select(*key, "frame", t, "_dt").unionByName(pads).join(good, key, "left_semi")
    channel = F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col(t).alias("v")), F.struct(F.lit(1).alias("c"), (F.col(t) + F.col("_dt") / 2).alias("v"))))
    return first.select(*key, "frame", channel.alias("s")).select(*key, F.col("s.c").alias("channel"), "frame", F.col("s.v").alias(t))


def uniform_times(recordings: DataFrame, key: list[str], t0: str, t1: str, n: str) -> DataFrame:
    """``key, i, t``: n stamps from t0 to t1, both included."""
    i = F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias("i")
    return recordings.where(F.col(n) > 0).select(*key, t0, t1, n, i).select(*key, "i", F.when(F.col(n) == 1, F.col(t0)).otherwise(F.col(t0) + F.col("i") * (F.col(t1) - F.col(t0)) / (F.col(n) - 1)).alias("t"))


def spine(frames: DataFrame, key: list[str], n: str, out: str = "frame") -> DataFrame:
    return frames.where(F.col(n) > 0).select(*key, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias(out))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: str, direction: str = "backward", strict: bool = False, out: str | None = None) -> DataFrame:
    """``left`` with the last (first) ``value`` of ``right`` at or before (after) its time; ``strict`` leaves equal times out.

    One sort of the union of both sides by key and time; no range join. Null where there is none. Looking forward sorts the other way round, as a
    frame that ends with the recording would be summed anew for every row.
    """
    out = out or value
    back = direction == "backward"
    names = left.columns
    tag = (1 if back else -1) * (-1 if not strict else 1)  # whether a right row sorts before a left row of equal time
    a = left.select(*names, F.col(left_on).alias("_t"), F.lit(0).alias("_tag"), F.lit(None).alias("_v"))
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in names], F.col(right_on).alias("_t"), F.lit(tag).alias("_tag"), F.struct(F.col(value).alias("v")).alias("_v"))
    a = a.withColumn("_v", F.lit(None).cast(dict(b.dtypes)["_v"]))
    order = ["_t", "_tag"] if back else [F.desc("_t"), F.desc("_tag")]
    found = F.last("_v", True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("_f", found).where("_tag = 0").select(*names, F.col("_f.v").alias(out))


def searchsorted(events: DataFrame, samples: DataFrame, by: list[str], event_t: str, sample_t: str, index: str, clip: bool = True, out: str = "index") -> DataFrame:
    """Index of the first sample at or after each event; past the end the last index (``clip``) or the sample count."""
    found = asof(events, samples, by, event_t, sample_t, index, "forward", out=out)
    last = samples.groupBy(by).agg(F.max(index).alias("_last"))
    return found.join(last, by, "left").withColumn(out, F.coalesce(out, F.col("_last") + F.lit(0 if clip else 1))).drop("_last")


def interp(target: DataFrame, source: DataFrame, by: list[str], t: str, value: str, method: str = "linear", out: str | None = None) -> DataFrame:
    """``value`` of ``source`` at the times of ``target``: linear with clamped ends, or nearest with ties to the earlier sample.

    Both neighbours come from one shuffle of the union of both sides; a sample at the very time is the earlier neighbour.
    """
    out = out or value
    knot = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    types = dict(target.dtypes)
    rows = source.select(*[F.col(c) if c in by else F.lit(None).cast(types[c]).alias(c) for c in target.columns], F.col(t).alias("_t"), F.lit(0).alias("_tag"), knot.alias("_s"))
    rows = target.select(*target.columns, F.col(t).alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(dict(rows.dtypes)["_s"]).alias("_s")).unionByName(rows)
    near = lambda *order: F.last("_s", True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumns({"_a": near("_t", "_tag"), "_b": near(F.desc("_t"), F.desc("_tag"))}).where("_tag = 1").drop("_t", "_tag", "_s")
    a, b, at = F.col("_a"), F.col("_b"), F.col(t)
    if method == "nearest":
        inside = F.when(at - a["t"] <= b["t"] - at, a["v"]).otherwise(b["v"])
    else:
        inside = F.when(b["t"] == a["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (at - a["t"]) / (b["t"] - a["t"]))
    return both.withColumn(out, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inside)).drop("_a", "_b")


def mask_interpolate(points: DataFrame, by: list[str], frame: str, value: str, confidence: str, cutoff: float) -> DataFrame:
    """Values at confidence of ``cutoff`` or less are replaced by interpolation between the others."""
    sure = points.where(F.col(confidence) > cutoff).select(*by, frame, F.col(value).alias("_sure"))
    filled = interp(points, sure, by, frame, "_sure", out="_filled")
    return filled.withColumn(value, F.when(F.col(confidence) > cutoff, F.col(value)).otherwise(F.col("_filled"))).drop("_filled")


def fir(df: DataFrame, key: list[str], order: list, column: str, taps: list[float], out: str, edge: str = "null") -> DataFrame:
    """Centred weighted sum over neighbours; at the ends null, or with the end's value held (``hold``)."""
    half, w = len(taps) // 2, _w(key, order)
    whole = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(0.0)
    for k, c in enumerate(taps):
        d = k - half
        v = F.lead(column, d).over(w) if d > 0 else F.lag(column, -d).over(w) if d < 0 else F.col(column)
        if edge == "hold":
            v = F.coalesce(v, F.last(column).over(whole) if d > 0 else F.first(column).over(whole))
        total = total + F.lit(float(c)) * v
    return df.withColumn(out, total)


def savgol_taps(window: int, degree: int, at: int | None = None) -> list[float]:
    """Weights of the least-squares polynomial's value at a place of the window (its middle by default)."""
    import numpy as np

    at = window // 2 if at is None else at
    x = np.arange(window) - at
    return np.linalg.pinv(np.vander(x, degree + 1, increasing=True))[0].tolist()


def savgol(df: DataFrame, key: list[str], order: list, column: str, window: int, degree: int, out: str) -> DataFrame:
    """Savitzky-Golay smoothing; near the ends the value of the first or last window's polynomial.

    Recordings shorter than the window are null.
    """
    half, w = window // 2, _w(key, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": n})
    rows = fir(rows, key, order, column, savgol_taps(window, degree), "_mid")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.collect_list(F.when((F.col("_i") < window) | (F.col("_i") >= F.col("_n") - window), F.struct("_i", column))).over(whole)
    rows = rows.withColumn("_ends", F.when((F.col("_i") < half) | (F.col("_i") >= F.col("_n") - half), values))
    head = F.transform(F.slice("_ends", 1, window), lambda x: x[column])
    tail = F.transform(F.slice("_ends", -window, window), lambda x: x[column])
    fitted = F.col("_mid")
    dot = lambda v, taps: F.aggregate(F.zip_with(v, F.lit(taps), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    for k in range(half):
        fitted = F.when(F.col("_i") == k, dot(head, savgol_taps(window, degree, k))).when(F.col("_i") == F.col("_n") - 1 - k, dot(tail, savgol_taps(window, degree, window - 1 - k))).otherwise(fitted)
    return rows.withColumn(out, F.when(F.col("_n") >= window, fitted)).drop("_i", "_n", "_mid", "_ends")


def clip(column: str, low: float | None = None, high: float | None = None) -> Column:
    c = F.col(column)
    c = F.greatest(c, F.lit(low)) if low is not None else c
    return F.least(c, F.lit(high)) if high is not None else c


def gradient(df: DataFrame, key: list[str], order: list, columns: list[str], norm: str | None = None) -> DataFrame:
    """``d_<column>``: central differences, one-sided at the ends; ``norm`` names their Euclidean length."""
    w = _w(key, order)
    made = {}
    for c in columns:
        before, after, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        made[f"d_{c}"] = F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)
    out = df.withColumns(made)
    if norm:
        out = out.withColumn(norm, F.sqrt(sum((F.col(f"d_{c}") * F.col(f"d_{c}") for c in columns), F.lit(0.0))))
    return out


def weighted_mean(points: DataFrame, key: list[str], values: list[str], weight: str) -> DataFrame:
    return points.groupBy(key).agg(*[F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(weight)).alias(v) for v in values])


def mean_and_agreement(points: DataFrame, other: DataFrame, by: list[str], frame: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Mean over labels per frame, and its correlation with another tracker's series (null without one)."""
    mean = points.groupBy(*by, frame).agg(F.avg(value).alias(value))
    pair = mean.join(other.select(*by, frame, F.col(value).alias("_other")), [*by, frame], "left")
    return mean, pair.groupBy(by).agg(F.corr(value, "_other").alias("r"))


def fill_frames(points: DataFrame, frames: DataFrame, key: list[str], frame: str) -> DataFrame:
    """Every frame of the spine ``frames``, with ``p`` 1 where there is a point and 0 elsewhere."""
    return frames.join(points.withColumn("_in", F.lit(1)), [*key, frame], "left").withColumn("p", F.coalesce("_in", F.lit(0))).drop("_in")


def limb_features(points: DataFrame, anchor_x: str, anchor_y: str, key: list[str], order: list, window: int | None = None, degree: int = 2) -> DataFrame:
    """Distance to a point, velocity and acceleration of ``x, y``, each with its parts and length: nine columns.

    ``x`` and ``y`` are smoothed first if a ``window`` is given. Velocity and acceleration are per sample; the length of the acceleration is that of the
    gradient of the velocity's parts.
    """
    for c in ("x", "y") if window else ():
        points = savgol(points, key, order, c, window, degree, "_s").withColumn(c, F.col("_s")).drop("_s")
    length = lambda n: F.sqrt(F.col(f"{n}_x") * F.col(f"{n}_x") + F.col(f"{n}_y") * F.col(f"{n}_y"))
    out = points.withColumns({"distance_x": F.col("x") - F.col(anchor_x), "distance_y": F.col("y") - F.col(anchor_y)}).withColumn("distance", length("distance"))
    for name, x, y in (("velocity", "x", "y"), ("acceleration", "velocity_x", "velocity_y")):
        out = gradient(out, key, order, [x, y]).withColumnsRenamed({f"d_{x}": f"{name}_x", f"d_{y}": f"{name}_y"}).withColumn(name, length(name))
    return out


def wrapped_angle(dy: Column, dx: Column) -> Column:
    """90 degrees minus the direction, from -180 up to 180."""
    a = F.lit(90.0) - F.degrees(F.atan2(dy, dx))
    return F.when(a >= 180, a - 360).otherwise(a)


def finger_features(points: DataFrame, key: list[str], finger: str) -> DataFrame:
    """Shape of a hand from ``knuckle_x ... tip_y`` of its fingers 1 to 4, one row per ``key``; a part without its fingers is null.

    ``rotation_i`` is the knuckle-middle direction of a finger, ``bend_i`` the middle-tip direction less that, ``bend_alt_i`` its size; ``open_i`` is the
    absolute difference of the rotations of fingers i and i + 1, ``open_alt_24`` that of 2 and 4; ``.._24`` are means over fingers 2 to 4.
    """
    c = F.col
    upper = wrapped_angle(c("mid_y") - c("knuckle_y"), c("mid_x") - c("knuckle_x"))
    lower = wrapped_angle(c("tip_y") - c("mid_y"), c("tip_x") - c("mid_x"))
    each = points.withColumns({"rotation": upper, "bend": lower - upper}).withColumn("bend_alt", F.abs("bend"))
    hand = each.groupBy(key).agg(*[F.max(F.when(c(finger) == i, c(v))).alias(f"{v}_{i}") for v in ("bend", "bend_alt", "rotation") for i in range(1, 5)])
    hand = hand.withColumns({f"open_{i}": F.abs(c(f"rotation_{i + 1}") - c(f"rotation_{i}")) for i in range(1, 4)} | {"open_alt_24": F.abs(c("rotation_4") - c("rotation_2"))})
    means = {f"{v}_24": (c(f"{v}_2") + c(f"{v}_3") + c(f"{v}_4")) / 3 for v in ("bend", "bend_alt", "rotation")}
    return hand.withColumns(means | {"open_24": (c("open_2") + c("open_3")) / 2})


def closing(df: DataFrame, key: list[str], order: list, flag: str, k: int, out: str) -> DataFrame:
    """Binary closing with k rows: dilation, then erosion for which rows past the ends count as 0."""
    w = _w(key, order)
    before, after = k // 2, k - 1 - k // 2
    grown = df.withColumn("_g", F.max(F.col(flag).cast("int")).over(w.rowsBetween(-after, before)))
    span = w.rowsBetween(-before, after)
    return grown.withColumn(out, (F.min("_g").over(span) == 1) & (F.count(F.lit(1)).over(span) == k)).drop("_g")


def segment(df: DataFrame, key: list[str], order: list, frame: str, t: str, flag: str, min_duration: float = 0.0) -> DataFrame:
    """Runs of ``flag`` as half-open ``[start_frame, end_frame)``; short ones go and ids count from 0 after that.

    ``end_time`` is the time of the first row after the run (of its last row, at the end of the recording).
    """
    w = _w(key, order)
    rows = df.withColumns({"_next": F.lead(t).over(w), "_next_frame": F.lead(frame).over(w)})
    out = runs(rows, key, order, flag).groupBy(*key, "run_id").agg(
        F.min(frame).alias("start_frame"),
        F.max_by(F.coalesce(F.col("_next_frame"), F.col(frame) + 1), frame).alias("end_frame"),
        F.min(t).alias("start_time"),
        F.max_by(F.coalesce(F.col("_next"), F.col(t)), frame).alias("end_time"),
    )
    out = out.where(F.col("end_time") - F.col("start_time") >= min_duration)
    return out.withColumn("epoch_id", F.row_number().over(_w(key, ["start_frame"])) - 1).drop("run_id")


def occupancy(points: DataFrame, bounds: DataFrame, key: list[str], frame: str, x: str = "x", left: float = 100, right: float = 60) -> DataFrame:
    """Labels left of, right of and inside the zone around ``bounds.x`` in each frame."""
    b = bounds.select(*key, (F.col(x) - left).cast("int").alias("_l"), (F.col(x) + right).cast("int").alias("_r"))
    j = points.join(b, key)
    n, v = F.count_if, F.col(x)
    return j.groupBy(*key, frame).agg(n(v < F.col("_l")).alias("n_left"), n(v > F.col("_r")).alias("n_right"), n((v >= F.col("_l")) & (v <= F.col("_r"))).alias("n_in"))


def crossings(df: DataFrame, key: list[str], order: list, a: str, b: str) -> DataFrame:
    """``crossing``: the step of sign(a - b), where 0 stands before the first row."""
    sign = F.signum(F.col(a) - F.col(b))
    rows = df.withColumn("_s", sign)
    return rows.withColumn("crossing", F.col("_s") - F.lag("_s", 1, 0.0).over(_w(key, order))).drop("_s")


def robust_z(df: DataFrame, key: list[str], column: str, out: str, limit: float = 7.5) -> DataFrame:
    w = Window.partitionBy(key)
    rows = df.withColumn("_m", F.median(column).over(w)).withColumn("_mad", F.median(F.abs(F.col(column) - F.col("_m"))).over(w))
    z = F.try_divide(F.col(column) - F.col("_m"), 1.4826 * F.col("_mad"))
    return rows.withColumn(out, F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("_m", "_mad")


def gauss_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(g) for x in g]
