"""Intervals over time series: membership, classification, summaries and event-aligned windows.

Range joins are equi-joins on nodes of dyadic grids. An interval goes to the grid whose cells are as wide as it is or up to twice as wide, and there touches two cells at most; a sample goes to its own cell of each grid
that some interval is in, at most one for each power of two between the shortest and the longest interval. A pair meets in one cell and cells are as narrow as the intervals are, in seconds or frames, so no width has to be chosen
and no nested loop over a recording is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINEST = -20  # the grid of 2 ** -20: intervals shorter than that share it
STEP = 4  # a grid is 2 ** STEP times as wide as the next finer one, so that intervals from 1 s to 10 days need five or six


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(2.0), level))


def placed(samples: DataFrame, intervals: DataFrame, on: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_level`` and ``_cell``, their rows repeated for each of their cells; intervals that end before they start, or have a null end, are left out."""
    length = (F.col(end) - F.col(start)).cast("double")
    level = (F.ceil(F.greatest(F.lit(FINEST), F.coalesce(F.ceil(F.log2(length)), F.lit(FINEST))) / STEP) * STEP).cast("int")  # few levels, as each costs a copy of the samples
    cells = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    levels = F.broadcast(cells.agg(F.collect_set("_level").alias("_levels")))  # one row, of no more levels than a double has exponents
    cells = cells.withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), F.col("_level")), _cell(F.col(end), F.col("_level")))))
    own = samples.where(F.col(on).isNotNull()).crossJoin(levels).withColumn("_level", F.explode("_levels")).drop("_levels")
    return own.withColumn("_cell", _cell(F.col(on), F.col("_level"))), cells


def within(samples: DataFrame, intervals: DataFrame, key: list[str], on: str, start: str, end: str, closed: str = "both") -> DataFrame:
    """Pairs of a sample and an interval that holds it; ``closed`` is both, left or right."""
    shared = set(samples.columns) & set(intervals.columns) - set(key)
    if shared:
        raise ValueError(f"columns of both sides: {sorted(shared)}")
    s, i = placed(samples, intervals, on, start, end)
    low = F.col(on) >= F.col(start) if closed in ("both", "left") else F.col(on) > F.col(start)
    high = F.col(on) <= F.col(end) if closed in ("both", "right") else F.col(on) < F.col(end)
    out = s.join(i, [*key, "_level", "_cell"]).where(low & high)
    return out.select(*samples.columns, *[c for c in intervals.columns if c not in key])


def interval_mask(samples: DataFrame, intervals: DataFrame, key: list[str], on: str, start: str, end: str, out: str = "inside", closed: str = "both") -> DataFrame:
    """``samples`` with a flag: in any interval. A running sum of starts less ends, so one sort and no pairs."""
    order = {"both": (-1, 1), "left": (-1, -1), "right": (1, 1)}[closed]
    cols = samples.columns
    cond = F.col(start) <= F.col(end) if closed == "both" else F.col(start) < F.col(end)
    marks = intervals.where(cond).select(*key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(order[0]).alias("o"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(order[1]).alias("o"), F.lit(-1).alias("d")))).alias("m"))
    types = dict(samples.dtypes)
    a = samples.select(*cols, F.col(on).cast("double").alias("_t"), F.lit(0).alias("_o"), F.lit(0).alias("_d"))
    b = marks.select(*[F.col(c) if c in key else F.lit(None).cast(types[c]).alias(c) for c in cols], F.col("m.t").cast("double").alias("_t"), F.col("m.o").alias("_o"), F.col("m.d").alias("_d"))
    w = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(out, F.sum("_d").over(w) > 0).where("_o = 0 and _d = 0").select(*cols, out)


def assign_crossings(cross: DataFrame, intervals: DataFrame, state: DataFrame, key: list[str], frame: str, flag: str, at: str = "start") -> DataFrame:
    """Intervals that are the first to hold a crossing (both ends included) and whose start (end) frame has ``flag``."""
    end = "start_frame" if at == "start" else "end_frame"
    good = intervals.join(state.where(F.col(flag)).select(*key, F.col(frame).alias(end)), [*key, end], "left_semi")
    pairs = within(cross.select(*key, F.col(frame).alias("_x")), good.select(*key, "epoch_id", "start_frame", "end_frame"), key, "_x", "start_frame", "end_frame")
    first = pairs.groupBy(*key, "_x").agg(F.min_by("epoch_id", F.struct("start_frame", "epoch_id")).alias("epoch_id"))
    return first.select(*key, "epoch_id").distinct()


def both_ends(intervals: DataFrame, state: DataFrame, key: list[str], frame: str, flag: str) -> DataFrame:
    on = state.where(F.col(flag)).select(*key, F.col(frame).alias("_f"))
    out = intervals.join(on.withColumnRenamed("_f", "start_frame"), [*key, "start_frame"], "left_semi")
    return out.join(on.withColumnRenamed("_f", "end_frame"), [*key, "end_frame"], "left_semi")


def presence(samples: DataFrame, windows: DataFrame, trials: DataFrame, key: list[str], t: str, value: str, q: float = 0.95, rank: int = 5, frac: float = 0.2, reference: float = 0.0) -> DataFrame:
    """First and last sample of each trial below a threshold.

    The baseline is the ``rank``-th smallest of the windows' ``q`` percentiles; the threshold lies ``frac`` of the way from it to ``reference``.
    """
    per = within(samples, windows, key, t, "w_start", "w_end").groupBy(*key, "window_id").agg(F.percentile(value, F.lit(q)).alias("p"))
    nth = per.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("p", "window_id"))).where(F.col("_r") == rank)
    thr = nth.select(*key, (F.col("p") - frac * F.abs(F.col("p") - reference)).alias("threshold"))
    inside = within(samples, trials, key, t, "t_start", "t_end").join(thr, key).where(F.col(value) < F.col("threshold"))
    return inside.groupBy(*key, "trial_id").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.first("threshold").alias("threshold"))


def classify_subepochs(sub: DataFrame, outs: DataFrame, reach: DataFrame, search: DataFrame, retract: DataFrame, key: list[str], tol: float = 0.075, exclude: float = 1.0, present: DataFrame | None = None) -> DataFrame:
    """``class``: excluded near an out-event, else reach, search or retract by membership in that order, else other.

    Sub-epochs are told apart by ``sub_epoch_id`` as well where ``sub`` has it. ``present`` (``key, frame`` of the frames with the lever in reach) adds
    ``presence_frames`` and ``presence_pct`` over ``[start_frame, end_frame)``.
    """
    ids = [*key, "epoch_id", *(["sub_epoch_id"] if "sub_epoch_id" in sub.columns else [])]
    o = outs.select(*key, F.col("t_out"))
    near = within(o, sub.select(*ids, (F.col("start_time") - tol).alias("_a"), F.col("end_time").alias("_b2")), key, "t_out", "_a", "_b2").select(ids)
    during = within(sub.select(*ids, "start_time"), o.select(*key, F.col("t_out").alias("_a"), (F.col("t_out") + exclude).alias("_b2")), key, "start_time", "_a", "_b2").select(ids)
    out = sub
    for name, members in (("excluded", near.unionByName(during).distinct()), ("reach", reach), ("search", search), ("retract", retract)):
        out = out.join(members.select(ids).distinct().withColumn(f"_{name}", F.lit(True)), ids, "left")
    label = F.lit("other")
    for name in ("retract", "search", "reach", "excluded"):
        label = F.when(F.col(f"_{name}"), name).otherwise(label)
    out = out.withColumn("class", label).drop("_excluded", "_reach", "_search", "_retract")
    if present is None:
        return out
    here = within(present.select(*key, F.col("frame").alias("_f")), sub.select(*ids, "start_frame", "end_frame"), key, "_f", "start_frame", "end_frame", closed="left")
    out = out.join(here.groupBy(ids).agg(F.count(F.lit(1)).alias("presence_frames")), ids, "left").withColumn("presence_frames", F.coalesce("presence_frames", F.lit(0)))
    return out.withColumn("presence_pct", F.try_divide(100.0 * F.col("presence_frames"), F.col("end_frame") - F.col("start_frame")))


def rewarded_epochs(rewards: DataFrame, epochs: DataFrame, key: list[str], t: str = "t", eps: float = 0.01, max_lag: float | None = None) -> DataFrame:
    """Epochs that are the latest to start over ``eps`` before some reward."""
    from .signal import asof

    shifted = epochs.select(*key, (F.col("start_time") + eps).alias("_s"), F.struct("start_time", "epoch_id").alias("_e"))
    found = asof(rewards.select(*key, t), shifted, key, t, "_s", "_e", "backward", strict=True)
    found = found.where(F.col("_e").isNotNull())
    if max_lag is not None:
        found = found.where(F.col(t) - F.col("_e.start_time") <= max_lag)
    return found.select(*key, F.col("_e.epoch_id").alias("epoch_id")).distinct()


def classify_epochs(sub_classes: DataFrame, rewarded: DataFrame, key: list[str], classes: tuple[str, ...] = ("reach", "search", "retract", "excluded", "other")) -> DataFrame:
    """Epoch class and, per class of its sub-epochs, their number and frames."""
    ids = [*key, "epoch_id"]
    frames = F.col("end_frame") - F.col("start_frame")
    sums = []
    for c in classes:
        sums += [F.count_if(F.col("class") == c).alias(f"n_{c}"), F.sum(F.when(F.col("class") == c, frames).otherwise(0)).alias(f"frames_{c}")]
    out = sub_classes.groupBy(ids).agg(F.count(F.lit(1)).alias("_n"), *sums).join(rewarded.select(ids).distinct().withColumn("_r", F.lit(True)), ids, "left")
    label = F.when(F.col("_r"), "rewarded").when(F.col("n_excluded") > F.col("_n") / 3, "excluded").when(F.col("n_reach") + F.col("n_search") > 0, "miss").otherwise("other")
    return out.withColumn("class", label).drop("_n", "_r")


def rest_mask(samples: DataFrame, key: list[str], still: str, presence_flag: str) -> tuple[DataFrame, DataFrame]:
    """``resting`` and ``moving`` flags, and per key the percentages of still and resting samples."""
    out = samples.withColumns({"resting": F.col(still) & F.col(presence_flag), "moving": ~F.col(still)})
    pct = out.groupBy(key).agg((100 * F.avg(F.col(still).cast("int"))).alias("pct_still"), (100 * F.avg(F.col("resting").cast("int"))).alias("pct_resting"))
    return out, pct


def hold_epochs(samples: DataFrame, key: list[str], order: list, frame: str, t: str, zone: str, signal: str, still: str, present: str, k: int, deflection: float = -1.63) -> DataFrame:
    """(zone or signal under ``deflection``) and still and present, closed over k rows, as epochs with ids from 1."""
    from .signal import closing, segment

    flagged = samples.withColumn("_h", (F.col(zone) | (F.col(signal) < deflection)) & F.col(still) & F.col(present))
    closed = closing(flagged, key, order, "_h", k, "_hold")
    return segment(closed, key, order, frame, t, "_hold").withColumn("epoch_id", F.col("epoch_id") + 1)


def interval_stats(features: DataFrame, intervals: DataFrame, key: list[str], frame: str, label: str, value: str, rest: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean and range of each feature in each interval, less its median at rest if a flag is named."""
    if labels is not None:
        features = features.where(F.col(label).isin(labels))
    if rest:
        base = features.where(F.col(rest)).groupBy(*key, label).agg(F.median(value).alias("_base"))
        features = features.join(base, [*key, label], "left").withColumn(value, F.col(value) - F.coalesce("_base", F.lit(0.0))).drop("_base")
    inside = within(features, intervals.select(*key, "epoch_id", "start_frame", "end_frame"), key, frame, "start_frame", "end_frame", closed="left")
    out = inside.groupBy(*key, "epoch_id", label).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return out.withColumn("range", F.col("max") - F.col("min"))


def align(events: DataFrame, samples: DataFrame, key: list[str], start: str, frame: str, before: int, after: int) -> DataFrame:
    """``events x offset`` with the sample at ``start + offset``; events whose window leaves the recording are left out."""
    ends = samples.groupBy(key).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))
    whole = events.join(ends, key).where((F.col(start) - before >= F.col("_lo")) & (F.col(start) + after <= F.col("_hi"))).drop("_lo", "_hi")
    spread = whole.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("_f", F.col(start) + F.col("offset"))
    return spread.join(samples.withColumnRenamed(frame, "_f"), [*key, "_f"]).drop("_f")


def mean_response(aligned: DataFrame, by: list[str], value: str, lo: int, hi: int) -> DataFrame:
    return aligned.where(F.col("offset").between(lo, hi)).groupBy(by).agg(F.avg(value).alias("response"))


def behavioural_events(parts: dict[str, DataFrame], key: list[str], t: str) -> DataFrame:
    """Named definitions of events, one under another: ``event_name, key, t``."""
    out = None
    for name, df in parts.items():
        own = df.select(F.lit(name).alias("event_name"), *key, F.col(t).alias("t"))
        out = own if out is None else out.unionByName(own)
    return out


def split_rest(samples: DataFrame, key: list[str], order: list, rest: str, covariate: str, value: str, skip: int = 120) -> DataFrame:
    """Mean of ``value`` per key in rest with a covariate up to and over its median at rest, after ``skip`` rows."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = samples.withColumn("_i", F.row_number().over(w)).where((F.col("_i") > skip) & F.col(rest))
    rows = rows.withColumn("_m", F.median(covariate).over(Window.partitionBy(key)))
    return rows.withColumn("state", F.when(F.col(covariate) > F.col("_m"), "high").otherwise("low")).groupBy(*key, "state").agg(F.avg(value).alias("mean"))


def rest_active_mean(samples: DataFrame, key: list[str], rest: str, value: str) -> DataFrame:
    return samples.groupBy(key).agg(F.avg(F.when(F.col(rest), F.col(value))).alias("rest"), F.avg(F.when(~F.col(rest), F.col(value))).alias("active"))


def movement_rates(epoch_classes: DataFrame, durations: DataFrame, key: list[str], classes: list[str], contra: DataFrame | None = None) -> DataFrame:
    """Counts per class divided by the session's duration, and accuracy = rewarded / (rewarded + miss) in per cent.

    With ``contra``, the epochs of the other hand, also ``total_movement_rate_contra`` and ``total_movement_rate_ipsi``; the latter sums all
    rates of the session, as the studied analysis does. A session without such epochs has no contra rate.
    """
    from .algebra import pivot_counts

    counts = pivot_counts(epoch_classes, key, "class", classes)
    rates = counts.join(durations, key).select(*key, *[(F.col(c) / F.col("duration")).alias(f"{c}_rate") for c in classes], F.try_divide(100 * F.col("rewarded"), F.col("rewarded") + F.col("miss")).alias("accuracy"))
    if contra is None:
        return rates
    other = contra.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(durations, key).select(*key, (F.col("_n") / F.col("duration")).alias("total_movement_rate_contra"))
    every = sum((F.coalesce(c, F.lit(0.0)) for c in [*(f"{c}_rate" for c in classes), "total_movement_rate_contra"]), F.lit(0.0))
    return rates.join(other, key, "left").withColumn("total_movement_rate_ipsi", every)
