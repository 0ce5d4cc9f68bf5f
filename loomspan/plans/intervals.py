"""Intervals over the recordings: runs of high values are epochs, purchases rewards, errors out-events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra as A
from ..operators import epochs as E
from ..operators import signal as G
from ..sources.files import materialised
from .registry import query, recordings, rounded
from .signals import EPOCHS_SQL, K, epochs, rec

_EP = "WITH " + EPOCHS_SQL


def _parts(s, d):
    return rec(s, d), epochs(s, d)


def _held(s, d):
    """Recordings and epochs as tables: what needs them several times reads them, as an analysis keeps its epochs between its steps."""
    return materialised(rec(s, d), "recordings"), materialised(epochs(s, d), "epochs")


@query("d24_interval_mask", _EP + " SELECT e.event_id, bool_or(p.user_id IS NOT NULL) AS inside FROM {events} e LEFT JOIN epochs p ON p.user_id = e.user_id AND e.t >= p.start_time AND e.t <= p.end_time GROUP BY 1")
def _(s, d):
    e, p = _parts(s, d)
    return E.interval_mask(e, p, K, "t", "start_time", "end_time").select("event_id", "inside")


@query("d25_interval_mask_open", _EP + " SELECT e.event_id, bool_or(p.user_id IS NOT NULL) AS inside FROM {events} e LEFT JOIN epochs p ON p.user_id = e.user_id AND e.i >= p.start_frame AND e.i < p.end_frame GROUP BY 1")
def _(s, d):
    e, p = _parts(s, d)
    return E.interval_mask(e, p, K, "i", "start_frame", "end_frame", closed="left").select("event_id", "inside")


_CROSS = EPOCHS_SQL + """,
cr AS (SELECT user_id, i, sign(value - 50) - coalesce(lag(sign(value - 50)) OVER (PARTITION BY user_id ORDER BY i), 0) AS c FROM {events}),
st AS (SELECT user_id, i, event_type <> 'error' AS ok FROM {events}),
good AS (SELECT e.* FROM epochs e JOIN st ON st.user_id = e.user_id AND st.i = e.start_frame WHERE ok),
reach AS (SELECT DISTINCT user_id, epoch_id FROM (SELECT cr.user_id, cr.i, arg_min(g.epoch_id, g.start_frame) AS epoch_id FROM cr JOIN good g ON g.user_id = cr.user_id AND cr.i BETWEEN g.start_frame AND g.end_frame WHERE c >= 1 GROUP BY 1, 2))"""


def _reach(e, p):
    cross = G.crossings(e.withColumn("b", F.lit(50.0)), K, ["i"], "value", "b").where("crossing >= 1")
    return E.assign_crossings(cross, p, e.withColumn("ok", F.col("event_type") != "error"), K, "i", "ok", at="start")


@query("d28_assign_crossings", "WITH " + _CROSS + " SELECT * FROM reach")
def _(s, d):
    return _reach(*_parts(s, d))


_ENDS = "ends AS (SELECT e.* FROM epochs e JOIN {events} a ON a.user_id = e.user_id AND a.i = e.start_frame JOIN {events} b ON b.user_id = e.user_id AND b.i = e.end_frame WHERE a.event_type IN ('click', 'view') AND b.event_type IN ('click', 'view', 'error'))"


def _both(e, p):
    start = e.where("event_type in ('click', 'view')").select("user_id", F.col("i").alias("start_frame"))
    return E.both_ends(p.join(start, ["user_id", "start_frame"], "left_semi"), e.withColumn("ok", F.col("event_type").isin("click", "view", "error")), K, "i", "ok")


@query("d29_both_ends", _EP + ", " + _ENDS + " SELECT user_id, epoch_id FROM ends")
def _(s, d):
    return _both(*_parts(s, d)).select("user_id", "epoch_id")


@query(
    "d30_presence",
    """WITH w AS (SELECT user_id, i // 8 AS window_id, min(t) AS a, max(t) AS b FROM {events} GROUP BY 1, 2),
p AS (SELECT w.user_id, w.window_id, quantile_cont(e.value, 0.95) AS p FROM w JOIN {events} e ON e.user_id = w.user_id AND e.t BETWEEN a AND b GROUP BY 1, 2),
b AS (SELECT user_id, p AS base FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p, window_id) = 5),
tr AS (SELECT user_id, i // 16 AS trial_id, min(t) AS t0, max(t) AS t1 FROM {events} GROUP BY 1, 2)
SELECT tr.user_id, trial_id, round(min(t), 3) AS first, round(max(t), 3) AS last FROM tr JOIN b USING (user_id) JOIN {events} e ON e.user_id = tr.user_id AND e.t BETWEEN t0 AND t1 AND e.value < base - 0.2 * abs(base - 10) GROUP BY 1, 2""",
)
def _(s, d):
    e = materialised(recordings(s, d).select("user_id", "i", "t", "value"), "recordings")  # read four times
    w = e.groupBy("user_id", F.floor(F.col("i") / 8).alias("window_id")).agg(F.min("t").alias("w_start"), F.max("t").alias("w_end"))
    tr = e.groupBy("user_id", F.floor(F.col("i") / 16).alias("trial_id")).agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    out = E.presence(e.select("user_id", "t", "value"), w, tr, K, "t", "value", reference=10.0)
    return rounded(out.select("user_id", "trial_id", "first", "last"), "first", "last", digits=3)


_CLASSES = _CROSS + ", " + _ENDS + """,
o AS (SELECT user_id, t FROM {events} WHERE event_type = 'error'),
ex AS (SELECT DISTINCT e.user_id, e.epoch_id FROM epochs e JOIN o ON o.user_id = e.user_id AND (o.t BETWEEN e.start_time - 60 AND e.end_time OR e.start_time BETWEEN o.t AND o.t + 7200)),
cls AS (SELECT e.*, CASE WHEN ex.user_id IS NOT NULL THEN 'excluded' WHEN r.user_id IS NOT NULL THEN 'reach' WHEN s.user_id IS NOT NULL THEN 'search' ELSE 'other' END AS class
  FROM epochs e LEFT JOIN ex USING (user_id, epoch_id) LEFT JOIN reach r USING (user_id, epoch_id) LEFT JOIN (SELECT user_id, epoch_id FROM ends) s USING (user_id, epoch_id))"""


def _classes(e, p):
    outs = e.where("event_type = 'error'").select("user_id", F.col("t").alias("t_out"))
    none = p.where("false").select("user_id", "epoch_id")
    return E.classify_subepochs(p, outs, _reach(e, p), _both(e, p).select("user_id", "epoch_id"), none, K, tol=60, exclude=7200)


@query(
    "d31_sub_epoch_class",
    "WITH " + _CLASSES + """, pf AS (SELECT p.user_id, p.epoch_id, count(*) AS n FROM epochs p JOIN {events} e ON e.user_id = p.user_id AND e.i >= p.start_frame AND e.i < p.end_frame WHERE e.event_type <> 'click' GROUP BY 1, 2)
SELECT cls.user_id, cls.epoch_id // 2 AS epoch_id, cls.epoch_id % 2 AS sub_epoch_id, CASE WHEN class = 'other' AND end_frame - start_frame = 1 THEN 'retract' ELSE class END AS class,
  coalesce(n, 0) AS presence_frames, round(100.0 * coalesce(n, 0) / (end_frame - start_frame), 6) AS presence_pct FROM cls LEFT JOIN pf ON pf.user_id = cls.user_id AND pf.epoch_id = cls.epoch_id""",
)
def _(s, d):
    e, p = _held(s, d)
    pairs = lambda df: df.withColumns({"sub_epoch_id": F.col("epoch_id") % 2, "epoch_id": F.floor(F.col("epoch_id") / 2)})
    outs = e.where("event_type = 'error'").select("user_id", F.col("t").alias("t_out"))
    present = e.where("event_type <> 'click'").select("user_id", F.col("i").alias("frame"))
    out = E.classify_subepochs(pairs(p), outs, pairs(_reach(e, p)), pairs(_both(e, p)), pairs(p.where("end_frame - start_frame = 1")), K, tol=60, exclude=7200, present=present)
    return rounded(out.select("user_id", "epoch_id", "sub_epoch_id", "class", "presence_frames", "presence_pct"), "presence_pct", digits=6)


_REWARDED = "rew AS (SELECT DISTINCT user_id, epoch_id FROM (SELECT p.user_id, p.t, arg_max(e.epoch_id, e.start_time) AS epoch_id FROM {events} p JOIN epochs e ON e.user_id = p.user_id AND p.t - e.start_time > 0.01 WHERE p.event_type = 'purchase' GROUP BY 1, 2))"


def _rewarded(e, p):
    return E.rewarded_epochs(e.where("event_type = 'purchase'"), p, K)


@query("d32_rewarded", _EP + ", " + _REWARDED + " SELECT * FROM rew")
def _(s, d):
    return _rewarded(*_parts(s, d))


_COARSE = "SELECT user_id, epoch_id // 3 AS big, class, end_frame - start_frame AS f FROM cls"


def _coarse(e, p):
    big = (F.floor(F.col("epoch_id") / 3)).alias("epoch_id")
    return _classes(e, p).select("user_id", big, "class", "start_frame", "end_frame"), _rewarded(e, p).select("user_id", big).distinct()


_EPOCH_CLASS = "WITH " + _CLASSES + ", " + _REWARDED + ", big AS (" + _COARSE + "), rb AS (SELECT DISTINCT user_id, epoch_id // 3 AS big FROM rew), ec AS (SELECT user_id, big AS epoch_id, CASE WHEN bool_or(rb.big IS NOT NULL) THEN 'rewarded' WHEN count(*) FILTER (class = 'excluded') > count(*) / 3.0 THEN 'excluded' WHEN count(*) FILTER (class IN ('reach', 'search')) > 0 THEN 'miss' ELSE 'other' END AS class, count(*) FILTER (class = 'reach') AS n_reach, coalesce(sum(f) FILTER (class = 'reach'), 0)::BIGINT AS frames_reach, count(*) FILTER (class = 'excluded') AS n_excluded FROM big LEFT JOIN rb USING (user_id, big) GROUP BY 1, 2)"


def _epoch_class(e, p):
    return E.classify_epochs(*_coarse(e, p), K)


@query("d33_epoch_class", _EPOCH_CLASS + " SELECT * FROM ec")
def _(s, d):
    return _epoch_class(*_held(s, d)).select("user_id", "epoch_id", "class", "n_reach", "frames_reach", "n_excluded")


@query("d34_rest", "SELECT user_id, round(100 * avg((value < 30)::INT), 6) AS pct_still, round(100 * avg((value < 30 AND event_type <> 'error')::INT), 6) AS pct_resting FROM events GROUP BY 1")
def _(s, d):
    e = recordings(s, d).withColumns({"still": F.col("value") < 30, "here": F.col("event_type") != "error"})
    return rounded(E.rest_mask(e, K, "still", "here")[1], "pct_still", "pct_resting", digits=6)


@query(
    "d35_hold",
    """WITH h AS (SELECT *, ((value > 30 OR i % 7 < 2) AND event_type <> 'error' AND i % 11 <> 5) AS h FROM {events}),
g AS (SELECT *, max(h::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM h),
c AS (SELECT *, min(g) OVER w = 1 AND count(*) OVER w = 3 AS f FROM g WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
q AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY i), FALSE) THEN 1 ELSE 0 END AS s FROM c),
r AS (SELECT * FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM q) WHERE f)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(i)) AS epoch_id, min(i) AS start_frame, max(i) + 1 AS end_frame FROM r GROUP BY user_id, run""",
)
def _(s, d):
    e = recordings(s, d).withColumns({"zone": F.col("value") > 30, "sig": F.when(F.col("i") % 7 < 2, -2.0).otherwise(0.0), "still": F.col("event_type") != "error", "here": F.col("i") % 11 != 5})
    return E.hold_epochs(e, K, ["i"], "i", "t", "zone", "sig", "still", "here", 3).select("user_id", "epoch_id", "start_frame", "end_frame")


_STATS = _EP + ", b AS (SELECT user_id, event_type, median(value) AS base FROM {events} WHERE value < 30 GROUP BY 1, 2), sst AS (SELECT e.user_id, p.epoch_id, e.event_type, min(e.value - coalesce(base, 0)) AS lo, max(e.value - coalesce(base, 0)) AS hi, avg(e.value - coalesce(base, 0)) AS mean FROM {events} e JOIN epochs p ON p.user_id = e.user_id AND e.i >= p.start_frame AND e.i < p.end_frame LEFT JOIN b ON b.user_id = e.user_id AND b.event_type = e.event_type WHERE e.event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3)"


def _stats(e, p):
    f = e.select("user_id", "i", "event_type", "value", (F.col("value") < 30).alias("still"))
    return E.interval_stats(f, p, K, "i", "event_type", "value", rest="still", labels=["click", "view", "purchase"])


@query("d36_interval_stats", _STATS + " SELECT user_id, epoch_id, event_type, round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 6) AS mean FROM sst")
def _(s, d):
    return rounded(_stats(*_parts(s, d)).drop("range"), "min", "max", "mean", digits=6)


@query("d37_ranges", _STATS + " SELECT user_id, epoch_id, event_type, round(hi - lo, 6) AS range FROM sst")
def _(s, d):
    return rounded(_stats(*_parts(s, d)).select("user_id", "epoch_id", "event_type", "range"), "range", digits=6)


@query("d38_other_limb", _EP + " SELECT p.user_id, p.epoch_id, count(*) AS n, round(avg(o.value), 6) AS mean FROM epochs p JOIN {events} o ON o.user_id = p.user_id + 1 AND o.t >= p.start_time AND o.t < p.end_time GROUP BY 1, 2")
def _(s, d):
    e, p = _parts(s, d)
    other = e.select((F.col("user_id") - 1).alias("user_id"), "t", "value")
    inside = E.within(other, p.select("user_id", "epoch_id", "start_time", "end_time"), K, "t", "start_time", "end_time", closed="left")
    return rounded(inside.groupBy("user_id", "epoch_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean", digits=6)


_ALIGN = "al AS (SELECT p.event_id, o.k AS \"offset\", s.value FROM {events} p CROSS JOIN (SELECT unnest(range(-3, 6)) AS k) o JOIN {events} s ON s.user_id = p.user_id AND s.i = p.i + o.k JOIN (SELECT user_id, max(i) AS hi FROM {events} GROUP BY 1) m ON m.user_id = p.user_id WHERE p.event_type = 'purchase' AND p.i - 3 >= 0 AND p.i + 5 <= hi)"


def _aligned(s, d):
    e = recordings(s, d)
    ev = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("i").alias("start"))
    return E.align(ev, e.select("user_id", "i", "value"), K, "start", "i", 3, 5)


@query("d39_align", "WITH " + _ALIGN + ' SELECT event_id, "offset", value FROM al')
def _(s, d):
    return _aligned(s, d).select("event_id", F.col("offset").cast("long").alias("offset"), "value")


@query("d40_mean_response", "WITH " + _ALIGN + ' SELECT event_id, round(avg(value), 6) AS response FROM al WHERE "offset" BETWEEN 0 AND 4 GROUP BY 1')
def _(s, d):
    return rounded(E.mean_response(_aligned(s, d), ["event_id"], "value", 0, 4), "response", digits=6)


@query("d41_behavioural_events", "SELECT 'reward' AS event_name, user_id, round(t, 3) AS t FROM {events} WHERE event_type = 'purchase' UNION ALL SELECT 'cue', user_id, round(t, 3) FROM {events} WHERE event_type = 'click' UNION ALL SELECT 'high', user_id, round(t, 3) FROM {events} WHERE value > 80")
def _(s, d):
    e = recordings(s, d)
    return rounded(E.behavioural_events({"reward": e.where("event_type = 'purchase'"), "cue": e.where("event_type = 'click'"), "high": e.where("value > 80")}, K, "t"), "t", digits=3)


@query("d42_split_rest", "WITH r AS (SELECT * FROM {events} WHERE i >= 10 AND event_type <> 'error'), m AS (SELECT user_id, median(t % 1000) AS m FROM r GROUP BY 1) SELECT r.user_id, CASE WHEN t % 1000 > m THEN 'high' ELSE 'low' END AS state, round(avg(value), 6) AS mean FROM r JOIN m ON r.user_id = m.user_id GROUP BY 1, 2")
def _(s, d):
    e = recordings(s, d).withColumns({"rest": F.col("event_type") != "error", "pupil": F.col("t") % 1000})
    return rounded(E.split_rest(e, K, ["i"], "rest", "pupil", "value", skip=10), "mean", digits=6)


@query("d43_rest_active", "SELECT user_id, round(avg(value) FILTER (event_type = 'view'), 6) AS rest, round(avg(value) FILTER (event_type <> 'view'), 6) AS active FROM events GROUP BY 1")
def _(s, d):
    return rounded(E.rest_active_mean(recordings(s, d).withColumn("r", F.col("event_type") == "view"), K, "r", "value"), "rest", "active", digits=6)


@query("d47_epoch_table", _STATS.replace("WITH " + EPOCHS_SQL, "WITH " + _CLASSES) + " SELECT sst.user_id, sst.epoch_id, class, event_type, round(mean, 6) AS mean FROM sst JOIN cls ON sst.user_id = cls.user_id AND sst.epoch_id = cls.epoch_id WHERE class <> 'other'")
def _(s, d):
    e, p = _held(s, d)
    out = A.natural_join(_stats(e, p).select("user_id", "epoch_id", "event_type", "mean"), _classes(e, p).select("user_id", "epoch_id", "class").where("class <> 'other'"))
    return rounded(out, "mean", digits=6)


@query("d48_movement_rates", _EPOCH_CLASS + ", du AS (SELECT user_id, max(t) - min(t) AS duration FROM {events} GROUP BY 1) SELECT user_id, round(count(*) FILTER (class = 'rewarded') / any_value(duration), 12) AS rewarded_rate, round(count(*) FILTER (class = 'miss') / any_value(duration), 12) AS miss_rate, round(100.0 * count(*) FILTER (class = 'rewarded') / nullif(count(*) FILTER (class IN ('rewarded', 'miss')), 0), 6) AS accuracy, round(any_value(n) / any_value(duration), 12) AS total_movement_rate_contra, round((count(*) FILTER (class IN ('rewarded', 'miss')) + coalesce(any_value(n), 0)) / any_value(duration), 12) AS total_movement_rate_ipsi FROM ec JOIN du USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY 1) USING (user_id) GROUP BY 1")
def _(s, d):
    e, p = _held(s, d)
    du = e.groupBy(K).agg((F.max("t") - F.min("t")).alias("duration"))
    out = E.movement_rates(_epoch_class(e, p).select("user_id", "epoch_id", "class"), du, K, ["rewarded", "miss"], contra=e.where("event_type = 'error'"))
    return rounded(rounded(out, "accuracy", digits=6), "rewarded_rate", "miss_rate", "total_movement_rate_contra", "total_movement_rate_ipsi", digits=12)
