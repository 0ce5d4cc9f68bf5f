"""Time series: every user's events are a recording, ``value`` its signal and ``t`` its clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as N
from ..operators import kernels
from ..operators import peaks as Q
from ..operators import signal as G
from .registry import query, recordings, rounded

K, I = ["user_id"], ["i"]


def rec(s, d):
    return recordings(s, d).withColumn("on", F.col("value") > 50)


@query("d1_binarise", "SELECT event_id, value > 50 AS flag FROM events")
def _(s, d):
    return recordings(s, d).select("event_id", G.binarise("value", 50).alias("flag"))


@query("d2_unknown_events", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase')")
def _(s, d):
    return G.unknown_events(recordings(s, d), "event_type", ["signup", "view", "click", "purchase"]).select("event_id", "event_type")


RUNS_SQL = """r AS (SELECT *, value > 50 AS f FROM {events}),
q AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER w, FALSE) THEN 1 ELSE 0 END AS s FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)),
runs AS (SELECT * FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run_id FROM q) WHERE f)"""


@query("d3_runs", "WITH " + RUNS_SQL + " SELECT event_id, user_id, run_id FROM runs QUALIFY run_id < max(run_id) OVER (PARTITION BY user_id)")
def _(s, d):
    return G.runs(rec(s, d), K, I, "on", drop_last=True).select("event_id", "user_id", "run_id")


@query("d4_run_times", "WITH " + RUNS_SQL + " SELECT user_id, run_id, round(median(t), 3) AS t, round(max(t) - min(t), 3) AS duration FROM runs GROUP BY 1, 2")
def _(s, d):
    return rounded(G.run_times(G.runs(rec(s, d), K, I, "on"), K, "t"), "t", "duration", digits=3)


_DT = "(SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM {events})"


@query("d5_sampling", f"SELECT user_id, round(median(dt), 3) AS dt_median, round(stddev_pop(dt), 3) AS dt_std, round(1 / avg(dt), 10) AS rate FROM {_DT} GROUP BY 1")
def _(s, d):
    out = rounded(G.sampling_stats(recordings(s, d), K, "t"), "dt_median", "dt_std", digits=3)
    return rounded(out, "rate", digits=10)


_GAPS = f"""g AS (SELECT *, median(dt) OVER (PARTITION BY user_id) AS m FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS dt FROM {{events}}))"""


@query("d6_gaps", "WITH " + _GAPS + " SELECT user_id, t, round(dt, 3) AS dt, round(m, 3) AS dt_median, dt > 2.5 * m AS too_long FROM g WHERE dt > 1.5 * m")
def _(s, d):
    return rounded(G.gaps(recordings(s, d), K, "t"), "dt", "dt_median", digits=3)


@query("d6_fill_gaps", "WITH " + _GAPS + " SELECT user_id, round(t, 3) AS t, FALSE AS added FROM g UNION ALL SELECT user_id, round(t + m, 3), TRUE FROM g WHERE dt > 1.5 * m")
def _(s, d):
    return rounded(G.fill_gaps(recordings(s, d), K, "t"), "t", digits=3)


@query(
    "d7_reconcile_clock",
    """WITH r AS (SELECT user_id, t, i, count(*) OVER (PARTITION BY user_id) AS n, median(lead_t - t) OVER (PARTITION BY user_id) AS dt
  FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY i) AS lead_t FROM {events})),
k AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN n // 2 + user_id % 4 ELSE n + user_id % 4 END AS nf FROM r),
h AS (SELECT user_id, nf, CASE WHEN abs(n // 2 - nf) <= 5 THEN i // 2 ELSE i END AS frame, t, CASE WHEN abs(n // 2 - nf) <= 5 THEN dt * 2 ELSE dt END AS dt FROM k WHERE NOT abs(n // 2 - nf) <= 5 OR i % 2 = 0),
e AS (SELECT user_id, nf, dt, max(frame) AS last, max(t) AS tl FROM h GROUP BY ALL),
a AS (SELECT h.user_id, h.frame, h.t, h.dt FROM h JOIN e USING (user_id) WHERE e.nf - 1 - e.last BETWEEN 0 AND 3
  UNION ALL SELECT user_id, last + p, tl + p * dt, dt FROM e, (VALUES (1), (2), (3)) v(p) WHERE nf - 1 - last BETWEEN 1 AND 3 AND p <= nf - 1 - last)
SELECT user_id, 0 AS channel, frame, round(t, 3) AS t FROM a UNION ALL SELECT user_id, 1, frame, round(t + dt / 2, 3) FROM a""",
)
def _(s, d):
    e = recordings(s, d)
    n = e.groupBy(K).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.when(F.col("user_id") % 2 == 0, F.floor(F.col("n") / 2)).otherwise(F.col("n")).alias("n_frames")).withColumn("n_frames", F.col("n_frames") + F.col("user_id") % 4)
    return rounded(G.reconcile_clock(e, n, K, "t"), "t", digits=3)


@query("d8_uniform_times", "SELECT user_id, k AS i, round(lo + k * (hi - lo) / (n - 1), 3) AS t FROM (SELECT user_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM {events} GROUP BY 1), LATERAL (SELECT unnest(range(n)) AS k)")
def _(s, d):
    r = recordings(s, d).groupBy(K).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    return rounded(G.uniform_times(r, K, "lo", "hi", "n"), "t", digits=3)


def _clicks(s, d):
    e = recordings(s, d)
    return e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select("user_id", "t", "value", "i")


@query("d9_searchsorted", "SELECT c.event_id, coalesce((SELECT min(p.i) FROM {events} p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.t >= c.t), (SELECT max(p.i) FROM {events} p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id)) AS index FROM {events} c WHERE c.event_type = 'click'")
def _(s, d):
    c, p = _clicks(s, d)
    return G.searchsorted(c, p, K, "t", "t", "i").select("event_id", "index")


_KNOTS = """c AS (SELECT * FROM {events} WHERE event_type = 'click'), p AS (SELECT user_id, t, value FROM {events} WHERE event_type = 'purchase'),
k AS (SELECT c.event_id, c.t, max(p.t) FILTER (p.t <= c.t) AS ta, min(p.t) FILTER (p.t >= c.t) AS tb, arg_max(p.value, p.t) FILTER (p.t <= c.t) AS va, arg_min(p.value, p.t) FILTER (p.t >= c.t) AS vb FROM c JOIN p USING (user_id) GROUP BY ALL)"""


@query("d10_interp", "WITH " + _KNOTS + " SELECT event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va WHEN ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 7) AS value FROM k")
def _(s, d):
    c, p = _clicks(s, d)
    return rounded(G.interp(c, p, K, "t", "value").select("event_id", "value"), "value")


@query("d11_nearest", "WITH " + _KNOTS + " SELECT event_id, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va WHEN t - ta <= tb - t THEN va ELSE vb END AS value FROM k")
def _(s, d):
    c, p = _clicks(s, d)
    return G.interp(c, p, K, "t", "value", method="nearest").select("event_id", "value")


@query(
    "d12_mask_interpolate",
    """WITH p AS (SELECT * FROM {events} WHERE event_type <> 'error'), k AS (SELECT c.event_id, c.event_type, c.value, c.i AS x, max(p.i) FILTER (p.i <= c.i) AS ta, min(p.i) FILTER (p.i >= c.i) AS tb, arg_max(p.value, p.i) FILTER (p.i <= c.i) AS va, arg_min(p.value, p.i) FILTER (p.i >= c.i) AS vb FROM {events} c JOIN p USING (user_id) GROUP BY ALL)
SELECT event_id, round(CASE WHEN event_type <> 'error' THEN value WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (x - ta) / (tb - ta) END, 7) AS value FROM k""",
)
def _(s, d):
    e = recordings(s, d).withColumn("p", F.when(F.col("event_type") == "error", 0.1).otherwise(0.9))
    return rounded(G.mask_interpolate(e, K, "i", "value", "p", 0.5).select("event_id", "value"), "value")


def _dot(terms: list[tuple[str, float]]) -> str:
    return " + ".join(f"({c!r}) * {v}" for v, c in terms)


_SG = _dot([(f"{'lead' if k > 0 else 'lag'}(value, {abs(k)}) OVER w" if k else "value", c) for k, c in zip(range(-3, 4), G.savgol_taps(7, 2))])
_HEAD = " ".join(f"WHEN i = {k} THEN " + _dot([(f"first[{j + 1}]", c) for j, c in enumerate(G.savgol_taps(7, 2, k))]) for k in range(3))
_TAIL = " ".join(f"WHEN i = n - 1 - {k} THEN " + _dot([(f"last[{j + 1}]", c) for j, c in enumerate(G.savgol_taps(7, 2, 6 - k))]) for k in range(3))


@query(
    "d13_savgol",
    f"""WITH m AS (SELECT user_id, count(*) AS n, list(value ORDER BY i)[1:7] AS first, list(value ORDER BY i)[-7:] AS last FROM {{events}} GROUP BY 1),
r AS (SELECT *, {_SG} AS mid FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, round(CASE {_HEAD} {_TAIL} ELSE mid END, 7) AS smooth FROM r JOIN m USING (user_id)""",
)
def _(s, d):
    return rounded(G.savgol(recordings(s, d), K, I, "value", 7, 2, "smooth").select("event_id", "smooth"), "smooth")


@query("d14_clip", "SELECT event_id, least(greatest(value, 10.0), 60.0) AS value FROM events")
def _(s, d):
    return recordings(s, d).select("event_id", G.clip("value", 10.0, 60.0).alias("value"))


@query("d15_gradient", "SELECT event_id, round(sqrt(d * d + 0.25 * d * d), 7) AS speed FROM (SELECT event_id, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS d FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY i))")
def _(s, d):
    e = recordings(s, d).withColumn("y", F.col("value") / 2)
    return rounded(G.gradient(e, K, I, ["value", "y"], norm="speed").select("event_id", "speed"), "speed")


@query("d16_weighted_mean", "SELECT user_id, event_type, round(sum(value * (i % 5)) / nullif(sum(i % 5), 0), 7) AS value FROM {events} GROUP BY 1, 2")
def _(s, d):
    e = recordings(s, d).withColumn("p", F.col("i") % 5)
    return rounded(G.weighted_mean(e, ["user_id", "event_type"], ["value"], "p"), "value")


@query("d17_agreement", "SELECT user_id, round(corr(a, b), 6) AS r FROM (SELECT user_id, i // 4 AS frame, avg(value) AS a, min(t) FILTER (event_type = 'purchase') AS b FROM {events} GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    e = recordings(s, d).withColumn("frame", F.floor(F.col("i") / 4))
    other = e.where("event_type = 'purchase'").groupBy("user_id", "frame").agg(F.min("t").alias("value"))  # has some of the frames
    return rounded(G.mean_and_agreement(e, other, K, "frame", "value")[1], "r", digits=6)


@query("d18_fill_frames", "SELECT f.user_id, f.frame, e.value, CASE WHEN e.user_id IS NULL THEN 0 ELSE 1 END AS p FROM (SELECT user_id, unnest(range(max(i) + 3)) AS frame FROM {events} GROUP BY user_id) f LEFT JOIN (SELECT user_id, i, value FROM {events} WHERE event_type <> 'error') e ON e.user_id = f.user_id AND e.i = f.frame")
def _(s, d):
    e = recordings(s, d)
    frames = G.spine(e.groupBy(K).agg((F.max("i") + 3).alias("n")), K, "n").withColumn("frame", F.col("frame").cast("int"))
    return G.fill_frames(e.where("event_type <> 'error'").select("user_id", F.col("i").alias("frame"), "value"), frames, K, "frame")


_GRAD = "CASE WHEN lag({0}) OVER w IS NULL THEN lead({0}) OVER w - {0} WHEN lead({0}) OVER w IS NULL THEN {0} - lag({0}) OVER w ELSE (lead({0}) OVER w - lag({0}) OVER w) / 2 END"


_LIMB = ["distance_x", "distance_y", "distance", "velocity_x", "velocity_y", "velocity", "acceleration_x", "acceleration_y", "acceleration"]
_LENGTH = "sqrt(pow({0}x, 2) + pow({0}y, 2))"


@query(
    "d19_limb_features",
    f"""WITH m AS (SELECT user_id, count(*) AS n, list(value ORDER BY i)[1:7] AS first, list(value ORDER BY i)[-7:] AS last FROM {{events}} GROUP BY 1),
r AS (SELECT *, {_SG} AS mid FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY i)),
a AS (SELECT event_id, user_id, i, CASE {_HEAD} {_TAIL} ELSE mid END AS x, (CASE {_HEAD} {_TAIL} ELSE mid END) / 3.7 + 1 AS y FROM r JOIN m USING (user_id)),
v AS (SELECT *, {_GRAD.format("x")} AS vx, {_GRAD.format("y")} AS vy FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT *, {_GRAD.format("vx")} AS ax, {_GRAD.format("vy")} AS ay, x - 50 AS dx, y - 20 AS dy FROM v WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, {", ".join(f"round({e}, 6) AS {n}" for e, n in zip(["dx", "dy", _LENGTH.format("d"), "vx", "vy", _LENGTH.format("v"), "ax", "ay", _LENGTH.format("a")], _LIMB))} FROM c""",
)
def _(s, d):
    e = recordings(s, d).withColumns({"x": F.col("value"), "y": F.col("value") / 3.7 + 1, "ax": F.lit(50.0), "ay": F.lit(20.0)})
    return rounded(G.limb_features(e, "ax", "ay", K, I, window=7).select("event_id", *_LIMB), *_LIMB, digits=6)


_ANGLE = "CASE WHEN 90 - degrees(atan2({0}, {1})) >= 180 THEN 90 - degrees(atan2({0}, {1})) - 360 ELSE 90 - degrees(atan2({0}, {1})) END"
_HAND = {f"{v}_{i}": f"max({e}) FILTER (f = {i})" for v, e in (("bend", "lo - up"), ("bend_alt", "abs(lo - up)"), ("rotation", "up")) for i in range(1, 5)}
_OPEN = {f"open_{i}": f"abs(rotation_{i + 1} - rotation_{i})" for i in range(1, 4)} | {"open_alt_24": "abs(rotation_4 - rotation_2)"}
_MEAN = {f"{v}_24": f"({v}_2 + {v}_3 + {v}_4) / 3" for v in ("bend", "bend_alt", "rotation")} | {"open_24": "(abs(rotation_3 - rotation_2) + abs(rotation_4 - rotation_3)) / 2"}


@query(
    "d20_finger_features",
    "WITH p AS (SELECT l_orderkey, l_linenumber AS f, l_quantity AS kx, l_tax * 100 AS ky, l_discount * 100 AS mx, l_linenumber * 3.0 AS my, l_extendedprice / 1000 AS tx, l_suppkey / 2.0 AS ty FROM lineitem), "
    + f"a AS (SELECT l_orderkey, f, {_ANGLE.format('my - ky', 'mx - kx')} AS up, {_ANGLE.format('ty - my', 'tx - mx')} AS lo FROM p), "
    + f"h AS (SELECT l_orderkey, {', '.join(f'{e} AS {n}' for n, e in _HAND.items())} FROM a GROUP BY 1) "
    + f"SELECT l_orderkey, {', '.join(f'round({e}, 7) AS {n}' for n, e in ({n: n for n in _HAND} | _OPEN | _MEAN).items())} FROM h",
)
def _(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    p = li.selectExpr("l_orderkey", "l_linenumber", "l_quantity knuckle_x", "l_tax * 100 knuckle_y", "l_discount * 100 mid_x", "l_linenumber * 3.0D mid_y", "l_extendedprice / 1000 tip_x", "l_suppkey / 2.0D tip_y")
    return rounded(G.finger_features(p, ["l_orderkey"], "l_linenumber"), *_HAND, *_OPEN, *_MEAN)


@query("d21_closing", "WITH g AS (SELECT *, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM {events}) SELECT event_id, min(g) OVER w = 1 AND count(*) OVER w = 3 AS closed FROM g WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def _(s, d):
    return G.closing(rec(s, d), K, I, "on", 3, "closed").select("event_id", "closed")


EPOCHS_SQL = RUNS_SQL + """,
nx AS (SELECT event_id, lead(t) OVER (PARTITION BY user_id ORDER BY i) AS next_t FROM {events}),
ep0 AS (SELECT user_id, run_id, min(i) AS start_frame, max(i) + 1 AS end_frame, min(t) AS start_time, arg_max(coalesce(next_t, t), i) AS end_time FROM runs JOIN nx USING (event_id) GROUP BY 1, 2),
epochs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_frame) - 1 AS epoch_id, start_frame, end_frame, start_time, end_time FROM ep0 WHERE end_time - start_time >= 3600)"""


def epochs(s, d):
    return G.segment(rec(s, d), K, I, "i", "t", "on", min_duration=3600)


@query("d22_epochs", "WITH " + EPOCHS_SQL + " SELECT * FROM epochs")
def _(s, d):
    return epochs(s, d)


_RUNS = """e AS (SELECT user_id, i, -value AS x FROM {events}),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM e)),
r AS (SELECT user_id, min(i) AS a, max(i) AS b, any_value(x) AS x FROM g GROUP BY user_id, run),
pk AS (SELECT user_id, (a + b) // 2 AS pos, x FROM (SELECT *, lag(x) OVER w AS u, lead(x) OVER w AS v FROM r WINDOW w AS (PARTITION BY user_id ORDER BY a)) WHERE u < x AND v < x),
lo AS (SELECT p.user_id, p.pos, max(h.i) AS h FROM pk p LEFT JOIN e h ON h.user_id = p.user_id AND h.i < p.pos AND h.x > p.x GROUP BY 1, 2),
hi AS (SELECT p.user_id, p.pos, min(h.i) AS h FROM pk p LEFT JOIN e h ON h.user_id = p.user_id AND h.i > p.pos AND h.x > p.x GROUP BY 1, 2),
pr AS (SELECT p.user_id, p.pos, any_value(p.x) AS x, any_value(p.x) - greatest(min(e.x) FILTER (e.i <= p.pos), min(e.x) FILTER (e.i >= p.pos)) AS prominence
  FROM pk p JOIN lo ON lo.user_id = p.user_id AND lo.pos = p.pos JOIN hi ON hi.user_id = p.user_id AND hi.pos = p.pos JOIN e ON e.user_id = p.user_id AND e.i > coalesce(lo.h, -1) AND e.i < coalesce(hi.h, 1e9) GROUP BY 1, 2)"""


@query("d23_minima", "WITH " + _RUNS + " SELECT user_id, pos AS i, round(x, 7) AS height, round(prominence, 7) AS prominence FROM pr")
def _(s, d):
    e = recordings(s, d).select("user_id", "i", (-F.col("value")).alias("v"))
    return rounded(Q.find_peaks(e, K, "i", "v", samples=16).select("user_id", F.col("frame").alias("i"), "height", "prominence"), "height", "prominence")


@query(
    "d23_split",
    "WITH " + _RUNS + ", c AS (SELECT user_id, 1 AS s, pos AS i FROM pr WHERE prominence >= 20 UNION ALL SELECT user_id, 0, min(i) FROM e GROUP BY 1 UNION ALL SELECT user_id, 2, max(i) FROM e GROUP BY 1) "
    "SELECT user_id, row_number() OVER w - 1 AS sub_epoch_id, i AS start_frame, lead(i) OVER w AS end_frame FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s, i) QUALIFY end_frame IS NOT NULL",
)
def _(s, d):
    return Q.split_at_minima(recordings(s, d).select("user_id", "i", "value"), _whole(s, d), K, "i", "value", distance=1, prominence=20.0).select("user_id", "sub_epoch_id", "start_frame", "end_frame")


def _whole(s, d):
    return recordings(s, d).groupBy(K).agg(F.lit(0).alias("epoch_id"), F.min("i").alias("start_frame"), (F.max("i") + 1).alias("end_frame"))


@query("d23_sub_epochs")
def _(s, d):
    return Q.split_at_minima(recordings(s, d).select("user_id", "i", "value"), _whole(s, d), K, "i", "value", distance=3, prominence=20.0)


@query("d26_occupancy", "SELECT user_id, i // 10 AS frame, count(*) FILTER (value < CAST(trunc(55 - 20) AS INT)) AS n_left, count(*) FILTER (value > CAST(trunc(55 + 15) AS INT)) AS n_right, count(*) FILTER (value BETWEEN 35 AND 70) AS n_in FROM {events} GROUP BY 1, 2")
def _(s, d):
    e = recordings(s, d).select("user_id", F.floor(F.col("i") / 10).alias("frame"), F.col("value"))
    b = e.select("user_id").distinct().withColumn("value", F.lit(55.0))
    return G.occupancy(e, b, K, "frame", x="value", left=20, right=15)


@query("d27_crossings", "SELECT event_id, sign(value - 50) - coalesce(lag(sign(value - 50)) OVER (PARTITION BY user_id ORDER BY i), 0) AS crossing FROM {events}")
def _(s, d):
    e = recordings(s, d).withColumn("b", F.lit(50.0))
    return G.crossings(e, K, I, "value", "b").select("event_id", F.col("crossing").cast("double"))


@query("d44_robust_z", "WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), a AS (SELECT e.user_id, median(abs(value - m)) AS mad FROM events e JOIN m ON e.user_id = m.user_id GROUP BY 1) SELECT event_id, round(greatest(-7.5, least(7.5, (value - m) / nullif(1.4826 * mad, 0))), 7) AS z FROM events e JOIN m USING (user_id) JOIN a USING (user_id)")
def _(s, d):
    return rounded(G.robust_z(recordings(s, d), K, "value", "z").select("event_id", "z"), "z")


_TAPS = ", ".join(f"({k - 4}, {c!r})" for k, c in enumerate(G.gauss_taps(1.0)))


@query(
    "d45_gauss",
    f"""WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {{events}}),
j AS (SELECT event_id, user_id, c, n, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS q FROM e, (VALUES {_TAPS}) v(k, c))
SELECT j.event_id, round(sum(j.c * b.value), 7) AS smooth FROM j JOIN {{events}} b ON b.user_id = j.user_id AND b.i = CASE WHEN q >= n THEN 2 * n - 1 - q ELSE q END GROUP BY 1""",
)
def _(s, d):
    return rounded(N.gauss1d(recordings(s, d), K, "i", "value", 1.0, "smooth").select("event_id", "smooth"), "smooth")


(_B, _A), _S = kernels.butterworth(20.0, 0.1, 2)[0], kernels.settled(kernels.butterworth(20.0, 0.1, 2))[0]


def _pass(name: str, rows: str) -> str:
    """SQL of one pass of the filter over ``rows`` (user_id, j from 0, u): sample after sample, all users at once."""
    step = lambda z0, z1: f"{float(_B[0])!r} * u + {z0} AS y, {float(_B[1])!r} * u - {float(_A[0])!r} * ({float(_B[0])!r} * u + {z0}) + {z1} AS z0, {float(_B[2])!r} * u - {float(_A[1])!r} * ({float(_B[0])!r} * u + {z0}) AS z1"
    first = step(f"{float(_S[0])!r} * u", f"{float(_S[1])!r} * u")
    return f"{name} AS (SELECT user_id, j, {first} FROM {rows} WHERE j = 0 UNION ALL SELECT r.user_id, r.j, {step('z0', 'z1')} FROM {name} f JOIN {rows} r ON r.user_id = f.user_id AND r.j = f.j + 1)"


@query(
    "d46_temporal_filter",
    f"""WITH RECURSIVE e AS (SELECT *, count(*) OVER w AS n, least(9, count(*) OVER w - 1) AS p, first(value) OVER (w ORDER BY i) AS v0, last(value) OVER (w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1, avg(value) OVER w AS m
  FROM {{events}} WINDOW w AS (PARTITION BY user_id)),
x AS (SELECT user_id, i + p AS j, value - m AS u FROM e UNION ALL SELECT user_id, p - i, 2 * v0 - value - m FROM e WHERE i BETWEEN 1 AND p UNION ALL SELECT user_id, p + 2 * (n - 1) - i, 2 * v1 - value - m FROM e WHERE i BETWEEN n - 1 - p AND n - 2),
{_pass("ahead", "x")},
turned AS (SELECT user_id, max(j) OVER (PARTITION BY user_id) - j AS j, y AS u FROM ahead),
{_pass("back", "turned")}
SELECT e.event_id, e.user_id, round(CASE WHEN n < 2 THEN value ELSE b.y + m END, 6) AS filtered FROM e JOIN back b ON b.user_id = e.user_id AND b.j = n + p - 1 - i""",
)
def _(s, d):
    return rounded(N.temporal_filter(recordings(s, d).select("event_id", "user_id", "i", "value"), K, "i", "value", fs=20.0, fcutoff=0.1).select("event_id", "user_id", "filtered"), "filtered", digits=6)


@query("d46_filter_and_smooth")
def _(s, d):
    return N.temporal_filter(recordings(s, d).select("event_id", "user_id", "i", "value"), K, "i", "value", fs=20.0, fcutoff=0.1, sigma=1.0).drop("i", "value")
