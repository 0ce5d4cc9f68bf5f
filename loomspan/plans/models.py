"""Encoding models: purchases as events on the clock of a user's events; vectors as targets of designed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glm as L
from ..operators import gram as R
from ..operators import imaging as M
from .arrays import pixels
from .registry import query, recordings, rounded, table as T

K = ["user_id"]


def _clock(s, d):
    e = recordings(s, d)
    return e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").select("user_id", "t", (F.col("t") + 3600).alias("t_end"))


_HITS = "c AS (SELECT * FROM {events} WHERE event_type <> 'purchase'), ev AS (SELECT user_id, t FROM {events} WHERE event_type = 'purchase' UNION ALL SELECT user_id, t + 3600 FROM {events} WHERE event_type = 'purchase'), h AS (SELECT ev.user_id, coalesce(min(c.i) FILTER (c.t >= ev.t), max(c.i)) AS i FROM ev JOIN c ON c.user_id = ev.user_id GROUP BY ev.user_id, ev.t)"


@query("g1_event_regressor", "WITH " + _HITS + " SELECT c.user_id, c.i, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.user_id = c.user_id AND h.i = c.i) THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM c")
def _(s, d):
    clock, ev = _clock(s, d)
    return L.event_regressor(ev, clock, K, "t", "t", "i", which="both", end_t="t_end")


@query("g2_trial_regressor", "WITH c AS (SELECT * FROM {events} WHERE event_type <> 'purchase'), h AS (SELECT ev.user_id, coalesce(min(c.i) FILTER (c.t >= ev.t), max(c.i)) AS i FROM (SELECT user_id, t FROM {events} WHERE event_type = 'purchase' AND value > 10) ev JOIN c ON c.user_id = ev.user_id GROUP BY ev.user_id, ev.t) SELECT c.user_id, sum(CASE WHEN h.i IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE AS n FROM c LEFT JOIN (SELECT DISTINCT * FROM h) h ON h.user_id = c.user_id AND h.i = c.i GROUP BY 1")
def _(s, d):
    e = recordings(s, d)
    valve = e.where("event_type = 'purchase' AND value > 10").select("user_id", "t")
    return L.event_regressor(valve, e.where("event_type <> 'purchase'"), K, "t", "t", "i").groupBy("user_id").agg(F.sum("x").alias("n"))


_INTERP = "k AS (SELECT c.user_id, c.i, c.t, max(p.t) FILTER (p.t <= c.t) AS ta, min(p.t) FILTER (p.t >= c.t) AS tb, arg_max(p.value, p.t) FILTER (p.t <= c.t) AS va, arg_min(p.value, p.t) FILTER (p.t >= c.t) AS vb FROM {events} c JOIN {events} p ON p.user_id = c.user_id AND p.event_type = 'purchase' WHERE c.event_type <> 'purchase' GROUP BY ALL), x AS (SELECT user_id, i, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END AS x FROM k)"


@query("g3_analog_regressor", "WITH " + _INTERP + " SELECT user_id, i, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END, 6) AS x FROM x WINDOW w AS (PARTITION BY user_id)")
def _(s, d):
    e = recordings(s, d)
    return rounded(L.analog_regressor(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), K, "t", "value", "i", zscore=True), "x", digits=6)


@query("g4_zscore", "SELECT event_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 7) AS value FROM events WINDOW w AS (PARTITION BY user_id)")
def _(s, d):
    return rounded(L.standardise(recordings(s, d), K, "value").select("event_id", "value"), "value")


@query("g5_shuffle", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, round(sum(value * value), 4) AS squares FROM events GROUP BY 1")
def _(s, d):
    out = L.shuffle_rows(recordings(s, d).select("user_id", "i", "value"), K, "i", "value").groupBy("user_id")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares"))


_LAG = "SELECT a.user_id, a.i, k AS lag, b.value AS x FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {events}) a CROSS JOIN (SELECT unnest(range(-3, 4)) AS k) JOIN {events} b ON b.user_id = a.user_id AND b.i = ((a.i + k) % n + n) % n"


@query("g6_lag_expand", _LAG)
def _(s, d):
    return L.lag_expand(recordings(s, d).select("user_id", "i", "value"), K, "i", "value", list(range(-3, 4)))


def _kernel_sql() -> str:
    import numpy as np

    shifts, sigma = [-4, 0, 4], 2.0
    r = max(map(abs, shifts)) + int(sigma + 5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / int(sigma)) ** 2)
    g /= g.sum()
    return ", ".join(f"({k}, {(i + k + r) % (2 * r + 1) - r}, {float(g[i + r])!r})" for k in shifts for i in range(-r, r + 1))


@query("g7_gauss_expand", "SELECT e.user_id, e.i, v.lag, round(sum(CASE WHEN b.event_type = 'purchase' THEN c ELSE 0 END), 9) AS x FROM {events} e CROSS JOIN (VALUES " + _kernel_sql() + ") v(lag, j, c) LEFT JOIN {events} b ON b.user_id = e.user_id AND b.i = e.i - j GROUP BY 1, 2, 3")
def _(s, d):
    e = recordings(s, d).select("user_id", "i", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("v"))
    return rounded(L.gauss_expand(e, K, "i", "v", 2.0, [-4, 0, 4]), "x", digits=9)


@query("g8_design_matrix", "WITH l AS (SELECT user_id, i, 'value' AS reg, lag, x FROM (" + _LAG + ") UNION ALL SELECT user_id, i, 'click', 0, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END FROM {events} UNION ALL SELECT user_id, i, 'never', 0, 0.0 FROM {events}) SELECT user_id, i, reg, lag, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END, 6) AS x FROM (SELECT * FROM l QUALIFY max(abs(x)) OVER (PARTITION BY user_id, reg) > 0) WINDOW w AS (PARTITION BY user_id, reg, lag)")
def _(s, d):
    e = recordings(s, d)
    lagged = L.lag_expand(e.select("user_id", "i", "value"), K, "i", "value", list(range(-3, 4)))
    click = e.select("user_id", "i", F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("x"))
    return rounded(L.design_matrix({"value": lagged, "click": click, "never": e.select("user_id", "i", F.lit(0.0).alias("x"))}, K, "i"), "x", digits=6)


_SHIFTED = "x AS (SELECT user_id, i, n, (SELECT max(k) FROM (SELECT unnest([0, 1, 2, 3]) AS k) WHERE i >= k * (n // 4) + least(k, n % 4)) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {events})), l AS (" + _LAG + "), z AS (SELECT x.user_id, x.i, fold, lag + 3 AS col, l.x AS v FROM x JOIN l ON l.user_id = x.user_id AND l.i = x.i UNION ALL SELECT x.user_id, x.i, fold, 7, CASE WHEN e.event_type = 'click' THEN 1.0 ELSE 0.0 END FROM x JOIN {events} e ON e.user_id = x.user_id AND e.i = x.i)"


@query("g8_lagged_sums", "WITH " + _SHIFTED + " SELECT a.fold, a.col AS a, b.col AS b, round(sum(a.v * b.v), 4) AS v FROM z a JOIN z b ON a.user_id = b.user_id AND a.i = b.i AND a.col <= b.col GROUP BY ALL")
def _(s, d):
    # sums of products of seven lags of the value and of clicks, of the four folds of every recording
    rows = recordings(s, d).select("user_id", "i", F.array("value").alias("x"), F.array(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("y"))
    grams, p, q = R.lagged_grams(rows, K, "i", "x", "y", [list(range(-3, 4))], 4)
    cells = [(f, a, b, float(g[a + 1, b + 1])) for f, g in grams.items() for a in range(p + q) for b in range(a, p + q)]
    return rounded(s.createDataFrame(cells, "fold long, a long, b long, v double"), "v", digits=4)


@query("g9_model_table", "WITH v AS (SELECT event_type AS reg, -(count(*) % 60) AS lo, CASE WHEN event_type IN ('click', 'view') THEN count(*) % 60 ELSE 0 END AS hi FROM events GROUP BY 1) SELECT 'full_without_' || r.reg AS model_name, v.reg AS reg_name, v.reg = r.reg AS shuffle, v.lo AS first_lag, v.hi - v.lo + 1 AS n_lags, round(pow(10, 7.0 / 49), 9) AS second_alpha FROM v CROSS JOIN v r")
def _(s, d):
    n = F.count(F.lit(1)) % 60
    regressors = T(s, d, "events").groupBy(F.col("event_type").alias("reg_name")).agg((-n).alias("first_lag"), F.when(F.col("event_type").isin("click", "view"), n).otherwise(F.lit(0)).alias("last_lag"))
    models = L.reduced_models(L.model_table(regressors, "full"))
    lags = F.col("lag_frames")
    return models.select("model_name", "reg_name", "shuffle", lags[0].alias("first_lag"), F.size(lags).cast("long").alias("n_lags"), F.round(F.col("alphas")[1], 9).alias("second_alpha"))


_FOLD = "(SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS fold FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {events}))"


@query("g10_kfold", f"SELECT event_id, fold FROM {_FOLD}")
def _(s, d):
    return L.kfold(recordings(s, d), K, ["i"], 5).select("event_id", "fold")


_XY = "xy AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE * 0.5 + embedding[1]::DOUBLE AS y, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings))"


def _xy(s, d):
    """Rows with arrays ``x`` and ``y`` and a fold; contiguous folds of the whole table from its number of rows and ids."""
    e = T(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = e.count()
    q, r = n // 5, n % 5
    i = F.col("vec_id")  # ids count from 0 without gaps
    fold = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / max(q, 1))).cast("int")
    return e.withColumn("fold", fold)


_FIT = _XY + """, g AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) AS xx, sum(x * y) AS xy FROM xy JOIN (SELECT DISTINCT fold FROM xy) f ON f.fold <> xy.fold GROUP BY 1),
co AS (SELECT fold, (xy - n * mx * my) / (xx - n * mx * mx + 3.0) AS b, my, mx FROM g)"""


def _fit_one(s, d):
    rows = _xy(s, d).select("vec_id", "fold", F.array(F.col("v")[0]).alias("x"), F.array(F.col("v")[1] * 0.5 + F.col("v")[0]).alias("y"))
    return rows, L.ridge_cv(rows, 1, 1, [3.0])


@query("g11_ridge", "WITH " + _FIT + " SELECT fold, round(b, 7) AS coefficient, round(my - b * mx, 7) AS intercept FROM co")
def _(s, d):
    rows, fit = _fit_one(s, d)
    table = s.createDataFrame([(f, float(b[0, 0]), float(fit["intercepts"][f][0])) for f, b in fit["coefficients"].items()], "fold int, coefficient double, intercept double")
    return rounded(rows.select("fold").distinct().join(table, "fold"), "coefficient", "intercept")


_TWO = """xy AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[2]::DOUBLE * 0.5 + embedding[1]::DOUBLE - embedding[3]::DOUBLE AS y, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)),
m AS (SELECT f.fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) + 3.0 AS s11, var_pop(x2) * count(*) + 3.0 AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1, covar_pop(x2, y) * count(*) AS s2
  FROM xy JOIN (SELECT DISTINCT fold FROM xy) f ON f.fold <> xy.fold GROUP BY 1),
co AS (SELECT *, my - b1 * m1 - b2 * m2 AS c, my - b * m1 AS c0 FROM (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2, s1 / s11 AS b FROM m)),
r2 AS (SELECT fold, 1 - sum(pow(y - c - b1 * x1 - b2 * x2, 2)) / (var_pop(y) * count(*)) AS r_full, 1 - sum(pow(y - c0 - b * x1, 2)) / (var_pop(y) * count(*)) AS r_less FROM xy JOIN co USING (fold) GROUP BY fold)"""


def _two(s, d):
    v = F.col("v")
    return _xy(s, d).select("vec_id", "fold", F.array(v[0], v[2]).alias("x"), F.array(v[1] * 0.5 + v[0] - v[2]).alias("y"))


@query("g11_ridge_two_columns", "WITH " + _TWO + " SELECT fold, round(b1, 7) AS first, round(b2, 7) AS second, round(c, 7) AS intercept, round(r_full, 7) AS r2 FROM co JOIN r2 USING (fold)")
def _(s, d):
    rows = _two(s, d)
    fit = L.ridge_cv(rows, 2, 1, [3.0])
    table = s.createDataFrame([(f, float(b[0, 0]), float(b[1, 0]), float(fit["intercepts"][f][0]), float(r)) for (f, b), r in zip(fit["coefficients"].items(), fit["r2"])], "fold int, first double, second double, intercept double, r2 double")
    return rounded(rows.select("fold").distinct().join(table, "fold"), "first", "second", "intercept", "r2")


@query("g14_parts", "WITH " + _TWO + " SELECT vec_id, round(b1 * x1, 7) AS first, round(b2 * x2, 7) AS second, round(c - 0.25, 7) AS intercept, round(c - 0.25 + b1 * x1 + b2 * x2, 7) AS total, round(y, 7) AS \"true\" FROM xy JOIN co USING (fold)")
def _(s, d):
    rows = _two(s, d)
    out = L.parts_of_prediction(rows.withColumn("still", F.transform("y", lambda y: y - 0.25)), L.ridge_cv(rows, 2, 1, [3.0]), {"first": [0], "second": [1]}, "y", "still")
    parts = ["first", "second", "intercept", "total", "true"]
    return rounded(out.select("vec_id", *[F.col(c)[0].alias(c) for c in parts]), *parts)


@query("g18_delta_r2", "WITH " + _TWO + " SELECT fold, round(r_full - r_less, 7) AS delta_r2 FROM r2")
def _(s, d):
    # a full model of two columns and one without the second
    rows = _two(s, d)
    fits = [L.ridge_cv(df, p, 1, [3.0]) for df, p in ((rows, 2), (rows.withColumn("x", F.slice("x", 1, 1)), 1))]
    full, less = (s.createDataFrame([(f, float(r)) for f, r in zip(fit["coefficients"], fit["r2"])], "fold int, r2 double") for fit in fits)
    return rounded(L.unique_contribution(full, less, ["fold"]).select("fold", "delta_r2"), "delta_r2")


@query("g11_ridge_alphas")
def _(s, d):
    rows = _xy(s, d).select("vec_id", "fold", F.slice("v", 1, 4).alias("x"), F.transform(F.slice("v", 1, 8), lambda x, i: x + F.col("v")[0] * i).alias("y"))
    alphas = [10.0**k for k in range(-2, 5)]
    fit = L.ridge_cv(rows, 4, 8, alphas)
    scores = [(float(a), k, float(v)) for a, row in zip(alphas, fit["scores"]) for k, v in enumerate(row)]
    table = s.createDataFrame(scores, "alpha double, fold int, r2 double")
    return rows.select("fold").distinct().join(table, "fold")


_PAIRS = "pq AS (SELECT p - 1 AS pixel, embedding[p]::DOUBLE AS v, embedding[p % 64 + 1]::DOUBLE * 0.3 AS w FROM embeddings, (SELECT unnest(range(1, 65)) AS p))"


@query("g12_weighted_r2", "WITH " + _PAIRS + " SELECT round(1 - sum(sse) / sum(sst), 7) AS r2 FROM (SELECT pixel, sum(pow(v - w, 2)) AS sse, var_pop(v) * count(*) AS sst FROM pq GROUP BY 1)")
def _(s, d):
    e = T(s, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    rows = e.select("v", F.posexplode("v").alias("pixel", "a")).select("pixel", "a", (F.element_at("v", F.pmod(F.col("pixel") + 1, F.lit(64)) + 1) * 0.3).alias("b"))
    return rounded(L.weighted_r2(rows, [], "pixel", "a", "b"), "r2")


_R2_SUMS = ", ".join(f"covar_pop({a}{i}, {b}{j}) AS {a}{b}{i}{j}" for a, b in ("tt", "pp", "tp") for i in (0, 1) for j in (0, 1))
_R2_FORM = lambda ab: " + ".join(f"u{i} * u{j} * {ab}{i}{j}" for i in (0, 1) for j in (0, 1))


@query(
    "g13_r2_map",
    f"WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS t0, embedding[2]::DOUBLE AS t1, embedding[3]::DOUBLE AS p0, embedding[4]::DOUBLE AS p1, embedding[5]::DOUBLE AS u0, embedding[6]::DOUBLE AS u1 FROM embeddings), c AS (SELECT {_R2_SUMS} FROM m) SELECT vec_id AS pixel, round(pow({_R2_FORM('tp')}, 2) / (({_R2_FORM('tt')}) * ({_R2_FORM('pp')})), 6) AS r2 FROM m, c",
)
def _(s, d):
    e = T(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    u = e.select(F.col("vec_id").alias("pixel"), F.slice("v", 5, 2).alias("u"))
    return rounded(L.r2_map(e.select(F.slice("v", 1, 2).alias("truth"), F.slice("v", 3, 2).alias("pred")), u, 2), "r2", digits=6)


@query("g14_predict", "WITH " + _FIT + " SELECT vec_id, round(my + b * (x - mx), 7) AS predicted FROM xy JOIN co USING (fold)")
def _(s, d):
    rows, fit = _fit_one(s, d)
    return rounded(L.predict(rows, fit).select("vec_id", F.col("predicted")[0].alias("predicted")), "predicted")


@query("g15_coefficient_map", "SELECT vec_id AS pixel, round(sum(embedding[k + 1]::DOUBLE * (k % 7 - 3) / 2), 9) AS value FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY 1")
def _(s, d):
    u = pixels(s, d).select(F.col("vec_id").alias("pixel"), F.col("pixel").alias("component"), F.col("v").alias("u"))
    c = s.createDataFrame([(k, 0, (k % 7 - 3) / 2) for k in range(64)], "component int, frame int, s double")
    return rounded(M.reconstruct(u, c).select("pixel", "value"), "value", digits=9)


@query("g16_fold_average", f"SELECT user_id, round(avg(m), 7) AS value FROM (SELECT user_id, fold, avg(value) AS m FROM {_FOLD} GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    folds = L.kfold(recordings(s, d), K, ["i"], 5)
    return rounded(L.fold_average(L.fold_average(folds, ["user_id", "fold"], "value"), ["user_id"], "value"), "value")


@query("g17_roi_predictions", "WITH " + _FIT + " SELECT label AS roi, round(avg(my + b * (x - mx)), 7) AS mean FROM xy JOIN co USING (fold) GROUP BY 1")
def _(s, d):
    rows, fit = _fit_one(s, d)
    out = L.predict(rows, fit).select("vec_id", F.col("predicted")[0].alias("p"))
    rois = T(s, d, "embeddings").select("vec_id", F.col("label").alias("roi"))
    return rounded(out.join(rois, "vec_id").groupBy("roi").agg(F.avg("p").alias("mean")), "mean")


@query("g18_unique_contribution", "SELECT l_suppkey, round(pow(corr(l_extendedprice, l_quantity), 2) - pow(corr(l_extendedprice, l_tax), 2), 7) AS delta_r2 FROM lineitem GROUP BY 1")
def _(s, d):
    li = T(s, d, "lineitem").groupBy("l_suppkey")
    full = li.agg(F.pow(F.corr("l_extendedprice", "l_quantity"), 2).alias("r2"))
    reduced = li.agg(F.pow(F.corr("l_extendedprice", "l_tax"), 2).alias("r2"))
    return rounded(L.unique_contribution(full, reduced, ["l_suppkey"]).select("l_suppkey", "delta_r2"), "delta_r2")
