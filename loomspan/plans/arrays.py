"""Images and matrices: a vector is a frame of 8 x 8 pixels, its label the channel or session."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import imaging as M
from ..operators.signal import gauss_taps
from .registry import query, rounded, table as T

_PIX = "pix AS (SELECT vec_id, label, p - 1 AS pixel, embedding[p]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS p))"


def frames(s, d):
    return T(s, d, "embeddings").select(F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("pixels"))


def pixels(s, d):
    return frames(s, d).select("vec_id", "label", F.posexplode("pixels").alias("pixel", "v"))


def _mask(s, expr: str):
    return s.range(64).select(F.col("id").cast("int").alias("pixel")).withColumn("valid", F.expr(expr))


@query("e1_deinterleave", "SELECT vec_id % 2 AS channel, vec_id // 2 AS frame, label FROM embeddings")
def _(s, d):
    e = T(s, d, "embeddings").select(F.col("vec_id").alias("frame"), "label")
    return M.deinterleave(e).select("channel", "frame", "label")


@query("e2_template", "WITH " + _PIX + " SELECT label, pixel, round(avg(v), 7) AS template FROM pix WHERE vec_id < 100 GROUP BY 1, 2")
def _(s, d):
    return rounded(M.template(pixels(s, d), ["label"], "vec_id", "pixel", "v"), "template")


@query("e3_saturation", "WITH " + _PIX + " SELECT label, pixel, max(v) > 0.3 AS saturated FROM pix WHERE vec_id < 1200 GROUP BY 1, 2")
def _(s, d):
    return M.saturation_mask(pixels(s, d), ["label"], "vec_id", "pixel", "v", limit=0.3)


@query("e4_frame_shifts")
def _(s, d):
    f = frames(s, d).withColumnRenamed("vec_id", "frame")
    t = pixels(s, d).groupBy("label", "pixel").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel", "v"))), lambda x: x["v"]).alias("template"))
    return M.frame_shifts(f, t, ["label"], (8, 8), upsample=4)


@query("e4_whole_shifts", "SELECT label, vec_id AS frame, -(vec_id % 7 - 3)::DOUBLE AS dx, -(vec_id % 5 - 2)::DOUBLE AS dy FROM embeddings")
def _(s, d):
    # every frame is its label's first vector, moved around by whole pixels
    first = frames(s, d).groupBy("label").agg(F.min_by("pixels", "vec_id").alias("template"))
    x, y = F.col("frame") % 7 - 3, F.col("frame") % 5 - 2
    moved = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.element_at("template", (F.pmod(F.floor(p / 8) - y, F.lit(8)) * 8 + F.pmod(p % 8 - x, F.lit(8)) + 1).cast("int")))
    f = frames(s, d).select("label", F.col("vec_id").alias("frame")).join(first, "label").select("label", "frame", moved.alias("pixels"))
    return rounded(M.frame_shifts(f, first, ["label"], (8, 8), upsample=1), "dx", "dy")


_SHIFTS = "sh AS (SELECT label, vec_id % 2 AS channel, vec_id // 2 AS frame, vec_id // 2 % 2 AS part, embedding[1]::DOUBLE AS dx, embedding[2]::DOUBLE AS dy FROM embeddings)"


def _shifts(s, d):
    e = T(s, d, "embeddings").select("label", F.col("vec_id").alias("frame"), F.col("embedding")[0].cast("double").alias("dx"), F.col("embedding")[1].cast("double").alias("dy"))
    return M.deinterleave(e).withColumn("part", F.col("frame") % 2)


@query("e5_shift_summary", "WITH " + _SHIFTS + " SELECT label, part, channel, round(max(abs(dx)), 7) AS max_x, round(avg(dx), 7) AS mean_x, round(stddev_pop(dx), 7) AS std_x, round(max(abs(dy)), 7) AS max_y, round(avg(dy), 7) AS mean_y, round(stddev_pop(dy), 7) AS std_y FROM sh GROUP BY 1, 2, 3")
def _(s, d):
    return rounded(M.shift_summary(_shifts(s, d), ["label", "part", "channel"]), "max_x", "mean_x", "std_x", "max_y", "mean_y", "std_y")


@query("e5_channel_correlation", "WITH " + _SHIFTS + ", m AS (SELECT part, frame % 50 AS f, avg(dx) FILTER (channel = 0) AS a, avg(dx) FILTER (channel = 1) AS b, avg(dy) FILTER (channel = 0) AS c, avg(dy) FILTER (channel = 1) AS e FROM sh GROUP BY 1, 2) SELECT part, round(coalesce(corr(a, b), 0), 6) AS r_x, round(coalesce(corr(c, e), 0), 6) AS r_y FROM m GROUP BY 1")
def _(s, d):
    sh = _shifts(s, d).groupBy("part", "channel", (F.col("frame") % 50).alias("frame")).agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    return rounded(M.channel_correlation(sh, ["part"], "frame"), "r_x", "r_y", digits=6)


@query("e6_low_motion", "WITH " + _SHIFTS + ", su AS (SELECT label, part, channel, greatest(max(abs(dx)), max(abs(dy))) <= 0.45 AND greatest(stddev_pop(dx), stddev_pop(dy)) <= 0.14 AS ok FROM sh GROUP BY 1, 2, 3) SELECT label FROM su WHERE label <> 3 GROUP BY 1 HAVING count(*) FILTER (ok) = 4")
def _(s, d):
    summary = M.shift_summary(_shifts(s, d), ["label", "part", "channel"])
    return M.low_motion_sessions(summary, summary.where("label = 3").select("label"), ["label"], 0.45, 0.14)


@query("e7_affine", "SELECT vec_id, embedding[1]::DOUBLE AS dx, embedding[2]::DOUBLE AS dy, 1.0::DOUBLE AS m0 FROM embeddings")
def _(s, d):
    e = T(s, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")).withColumn("m", M.shift_to_affine("x", "y"))
    dx, dy = M.affine_to_shift("m")
    return e.select("vec_id", dx.alias("dx"), dy.alias("dy"), F.col("m")[0].alias("m0"))


@query("e8_spatial", "WITH " + _PIX + " SELECT vec_id, (pixel // 8 // 2) * 4 + pixel % 8 // 2 AS pixel, round(avg(v), 7) AS v FROM pix GROUP BY 1, 2")
def _(s, d):
    same = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    f = frames(s, d).select(F.col("vec_id").alias("frame"), "label", "pixels").withColumns({"motion": same, "session": same})
    out = M.spatial_process(f, ["label"], (8, 8), 0.0, (4, 4))
    return rounded(out.select(F.col("frame").alias("vec_id"), F.posexplode("pixels").alias("pixel", "v")), "v")


_BLUR = ", ".join(f"({k - 5}, {math.exp(-0.5 * (k - 5) ** 2) / sum(math.exp(-0.5 * j * j) for j in range(-5, 6))!r})" for k in range(11))
_MIRROR = "CASE WHEN ({0} + k + 16) % 16 >= 8 THEN 15 - ({0} + k + 16) % 16 ELSE ({0} + k + 16) % 16 END"


@query(
    "e8_blur_and_move",
    f"""WITH {_PIX}, taps AS (SELECT * FROM (VALUES {_BLUR}) t(k, c)),
mo AS (SELECT a.vec_id, y.y * 8 + x.x AS pixel, coalesce(l.v, 0) / 2 + CASE WHEN x.x < 8 THEN coalesce(a.v, 0) END / 2 AS v FROM (SELECT unnest(range(8)) AS y) y CROSS JOIN (SELECT unnest(range(8)) AS x) x JOIN pix a ON a.pixel = y.y * 8 + x.x LEFT JOIN pix l ON l.vec_id = a.vec_id AND x.x > 0 AND l.pixel = y.y * 8 + x.x - 1),
up AS (SELECT vec_id, pixel, {_MIRROR.format("pixel // 8")} AS q, c FROM mo CROSS JOIN taps), v1 AS (SELECT up.vec_id, up.pixel, sum(c * mo.v) AS v FROM up JOIN mo ON mo.vec_id = up.vec_id AND mo.pixel = q * 8 + up.pixel % 8 GROUP BY 1, 2),
ac AS (SELECT vec_id, pixel, {_MIRROR.format("pixel % 8")} AS q, c FROM v1 CROSS JOIN taps), v2 AS (SELECT ac.vec_id, ac.pixel, sum(c * v1.v) AS v FROM ac JOIN v1 ON v1.vec_id = ac.vec_id AND v1.pixel = ac.pixel // 8 * 8 + q GROUP BY 1, 2)
SELECT vec_id, (pixel // 8 // 2) * 4 + pixel % 8 // 2 AS pixel, round(avg(v), 7) AS v FROM v2 GROUP BY 1, 2""",
)
def _(s, d):
    half, same = (F.array(*[F.lit(float(x)) for x in m]) for m in ((1, 0, 0.5, 0, 1, 0), (1, 0, 0, 0, 1, 0)))
    f = frames(s, d).select(F.col("vec_id").alias("frame"), "label", "pixels").withColumns({"motion": half, "session": same})
    out = M.spatial_process(f, ["label"], (8, 8), 1.0, (4, 4))
    return rounded(out.select(F.col("frame").alias("vec_id"), F.posexplode("pixels").alias("pixel", "v")), "v")


@query("e9_temporal")
def _(s, d):
    f = frames(s, d).select(F.col("vec_id").alias("frame"), "label", "pixels")
    return M.temporal_process(M.frames_to_pixels(f, ["label"]), ["label"])


@query(
    "e9_smoothed",
    f"""WITH {_PIX}, e AS (SELECT label, pixel, v, row_number() OVER (PARTITION BY label, pixel ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label, pixel) AS n FROM pix),
j AS (SELECT label, pixel, i, n, c, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS q FROM e, (VALUES {", ".join(f"({k - 4}, {c!r})" for k, c in enumerate(gauss_taps(1.0)))}) v(k, c))
SELECT j.label, j.pixel, j.i, round(sum(j.c * b.v), 7) AS v FROM j JOIN e b ON b.label = j.label AND b.pixel = j.pixel AND b.i = CASE WHEN q >= j.n THEN 2 * j.n - 1 - q ELSE q END GROUP BY ALL""",
)
def _(s, d):
    f = frames(s, d).select(F.col("vec_id").alias("frame"), "label", "pixels")
    smooth = M.temporal_process(M.frames_to_pixels(f, ["label"], tile=16), ["label"], fcutoff=None, sigma=1.0)
    return rounded(smooth.select("label", "pixel", F.posexplode("series").alias("i", "v")), "v")


_PAIR = "pr AS (SELECT vec_id, label, i - 1 AS pixel, embedding[i]::DOUBLE AS v, embedding[(i % 64) + 1]::DOUBLE AS uv, embedding[((i + 6) % 64) + 1]::DOUBLE AS bg FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def _pairs(s, d):
    p = frames(s, d).select("vec_id", "label", "pixels", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pixel"))
    at = lambda k: F.element_at("pixels", F.pmod(F.col("pixel") + k, F.lit(64)) + 1)
    return p.select("vec_id", "label", "pixel", at(0).alias("v"), at(1).alias("uv"), at(7).alias("bg"))


@query("e10_regress_out", "WITH " + _PAIR + ", m AS (SELECT pixel, regr_slope(v, uv) AS b, avg(v) AS mv, avg(uv) AS mu FROM pr GROUP BY 1) SELECT vec_id, pr.pixel, round(v - mv - b * (uv - mu), 7) AS residual FROM pr JOIN m ON m.pixel = pr.pixel")
def _(s, d):
    return rounded(M.regress_out(_pairs(s, d), ["pixel"], "v", ["uv"]).select("vec_id", "pixel", "residual"), "residual")


@query(
    "e10_regress_two",
    "WITH " + _PAIR + """, m AS (SELECT pixel, avg(v) AS mv, avg(uv) AS mu, avg(bg) AS mb, var_pop(uv) AS s11, var_pop(bg) AS s22, covar_pop(uv, bg) AS s12, covar_pop(v, uv) AS s01, covar_pop(v, bg) AS s02 FROM pr GROUP BY 1)
SELECT vec_id, pr.pixel, round(v - mv - (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12) * (uv - mu) - (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12) * (bg - mb), 7) AS residual FROM pr JOIN m ON m.pixel = pr.pixel""",
)
def _(s, d):
    return rounded(M.regress_out(_pairs(s, d), ["pixel"], "v", ["uv", "bg"]).select("vec_id", "pixel", "residual"), "residual")


@query("e11_background", "WITH " + _PIX + " SELECT label, vec_id, round(avg(v), 7) AS background FROM pix WHERE NOT pixel % 3 = 0 GROUP BY 1, 2")
def _(s, d):
    return rounded(M.background(pixels(s, d), _mask(s, "pixel % 3 = 0"), ["label"], "vec_id", "pixel", "v"), "background")


@query("e12_delta_f", "WITH " + _PIX + ", m AS (SELECT label, pixel, avg(v) AS m FROM pix GROUP BY 1, 2) SELECT vec_id, pix.pixel, round(CASE WHEN pix.pixel % 5 < 4 THEN v / m ELSE 0 END, 5) AS dff FROM pix JOIN m ON m.label = pix.label AND m.pixel = pix.pixel")
def _(s, d):
    return rounded(M.delta_f(pixels(s, d), _mask(s, "pixel % 5 < 4"), ["label"], "pixel", "v", "v").select("vec_id", "pixel", "dff"), "dff", digits=5)


_BRIGHT = "br AS (SELECT pixel, avg(v) > 0.002 AS valid FROM pix GROUP BY 1)"


def _bright(s, d):
    return pixels(s, d).groupBy("pixel").agg((F.avg("v") > 0.002).alias("valid"))


@query("e13_dilate", "WITH " + _PIX + ", " + _BRIGHT + " SELECT a.pixel, bool_or(b.pixel IS NOT NULL) AS valid FROM br a LEFT JOIN br b ON b.valid AND abs(a.pixel % 8 - b.pixel % 8) <= 1 AND abs(a.pixel // 8 - b.pixel // 8) <= 1 GROUP BY 1")
def _(s, d):
    return M.morphology(_bright(s, d), 8, 8, 3)


@query("e13_erode", "WITH " + _PIX + ", " + _BRIGHT + " SELECT a.pixel, count(b.pixel) = 9 AS valid FROM br a LEFT JOIN br b ON b.valid AND abs(a.pixel % 8 - b.pixel % 8) <= 1 AND abs(a.pixel // 8 - b.pixel // 8) <= 1 GROUP BY 1")
def _(s, d):
    return M.morphology(_bright(s, d), 8, 8, 3, dilate=False)


@query("e14_svd")
def _(s, d):
    u, _, _ = M.truncated_svd(frames(s, d), "vec_id", "pixels", 64, 10)
    return u


@query("e14_lengths", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS squares FROM embeddings")
def _(s, d):
    # all 64 components together keep every row's length
    u, values, _ = M.truncated_svd(frames(s, d), "vec_id", "pixels", 64, 64)
    return u.select("vec_id", F.round(F.aggregate(F.zip_with("u", F.lit([float(v) for v in values]), lambda a, b: a * a * b * b), F.lit(0.0), lambda t, x: t + x), 6).alias("squares"))


_COMP = "WITH " + _PIX + ", u AS (SELECT pixel, vec_id AS component, v AS u FROM pix WHERE vec_id < 5), sv AS (SELECT pixel AS component, vec_id AS frame, v AS s FROM pix WHERE pixel < 5)"


def _components(s, d):
    p = pixels(s, d)
    return p.where("vec_id < 5").select("pixel", F.col("vec_id").cast("int").alias("component"), F.col("v").alias("u")), p.where("pixel < 5").select(F.col("pixel").alias("component"), F.col("vec_id").alias("frame"), F.col("v").alias("s"))


@query("e15_reconstruct", _COMP + " SELECT pixel, frame, round(sum(u * s), 9) AS value FROM u JOIN sv ON u.component = sv.component GROUP BY 1, 2")
def _(s, d):
    return rounded(M.reconstruct(*_components(s, d)), "value", digits=9)


@query("e16_baseline_still", "WITH " + _PIX + ", b AS (SELECT label, pixel, median(v) AS m FROM pix WHERE vec_id % 3 = 0 GROUP BY 1, 2) SELECT vec_id, pix.pixel, round(v - coalesce(m, 0), 7) AS v FROM pix LEFT JOIN b ON b.label = pix.label AND b.pixel = pix.pixel")
def _(s, d):
    still = frames(s, d).where("vec_id % 3 = 0").select("label", "vec_id")
    return rounded(M.baseline_still(pixels(s, d), still, ["label"], "vec_id", "pixel", "v").select("vec_id", "pixel", "v"), "v")


@query(
    "e16_components",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
st AS (SELECT u.label, u.vec_id AS pixel, f.vec_id AS frame, u.v[4] AS u0, u.v[5] AS u1, u.v[4] * f.v[1] + u.v[5] * f.v[2] AS x FROM e u JOIN e f ON f.label = u.label),
b AS (SELECT label, pixel, median(x) AS b FROM st WHERE frame % 3 = 0 GROUP BY 1, 2)
SELECT label, frame, round(sum(CASE WHEN pixel % 4 <> 1 THEN u0 * (x - b) ELSE 0 END), 7) AS first, round(sum(CASE WHEN pixel % 4 <> 1 THEN u1 * (x - b) ELSE 0 END), 7) AS second FROM st JOIN b USING (label, pixel) GROUP BY 1, 2""",
)
def _(s, d):
    # a label is a session; its vectors are both its frames (two numbers) and its pixels (two others)
    e = frames(s, d)
    comp = e.select("label", F.col("vec_id").alias("frame"), F.slice("pixels", 1, 2).alias("sv"))
    u = e.select("label", F.col("vec_id").alias("pixel"), F.slice("pixels", 4, 2).alias("u"))
    mask = e.select(F.col("vec_id").alias("pixel"), (F.col("vec_id") % 4 != 1).alias("valid"))
    out, _ = M.baseline_components(comp, u, comp.where("frame % 3 = 0").select("label", "frame"), ["label"], mask, tile=16)
    return rounded(out.select("label", "frame", F.col("sv")[0].alias("first"), F.col("sv")[1].alias("second")), "first", "second")


@query("e17_rescale_affine", "SELECT vec_id, round(embedding[3]::DOUBLE * 0.25, 9) AS tx, round(embedding[6]::DOUBLE * 0.25, 9) AS ty, embedding[1]::DOUBLE AS a FROM embeddings")
def _(s, d):
    m = frames(s, d).withColumn("m", M.rescale_affine("pixels", 0.25))
    return rounded(m.select("vec_id", F.col("m")[2].alias("tx"), F.col("m")[5].alias("ty"), F.col("m")[0].alias("a")), "tx", "ty", digits=9)


@query(
    "e18_affine_points",
    """WITH m AS (SELECT vec_id, label, 1 + embedding[1]::DOUBLE * 0.1 AS a, embedding[2]::DOUBLE * 0.1 AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE * 0.1 AS d, 1 + embedding[5]::DOUBLE * 0.1 AS e, embedding[6]::DOUBLE AS f FROM embeddings)
SELECT vec_id, round(2 * a + 5 * b + c, 6) AS x, round(2 * d + 5 * e + f, 6) AS y, round((e * (2 - c) - b * (5 - f)) / (a * e - b * d), 6) AS back_x, round((a * (5 - f) - d * (2 - c)) / (a * e - b * d), 6) AS back_y, CASE WHEN label % 2 = 0 THEN 5 ELSE 2 END AS flipped FROM m""",
)
def _(s, d):
    a = F.col("pixels")
    m = F.array(F.lit(1.0) + a[0] * 0.1, a[1] * 0.1, a[2], a[3] * 0.1, F.lit(1.0) + a[4] * 0.1, a[5])
    e = frames(s, d).withColumns({"m": m, "x": F.lit(2.0), "y": F.lit(5.0)}).withColumn("inv", M.invert_affine("m"))
    (x, y), (bx, by) = M.apply_affine("m", "x", "y"), M.apply_affine("inv", "x", "y")
    out = e.select("vec_id", x.alias("x"), y.alias("y"), bx.alias("back_x"), by.alias("back_y"), M.flip_x("x", 8, F.col("label") % 2 == 0).cast("int").alias("flipped"))
    return rounded(out, "x", "y", "back_x", "back_y", digits=6)


def _rois(s):
    return s.range(64).select(F.col("id").cast("int").alias("pixel"), F.concat(F.lit("roi_"), (F.col("id") % 4).cast("string")).alias("roi"))


@query("e19_roi_trace", "WITH " + _PIX + " SELECT 'roi_' || (pixel % 4) AS roi, label, vec_id, round(avg(v), 7) AS mean, count(*) AS n_pixels FROM pix WHERE pixel >= 8 GROUP BY 1, 2, 3")
def _(s, d):
    out = M.roi_mean(pixels(s, d), _rois(s), ["label"], "pixel", "v", "vec_id", _mask(s, "pixel >= 8"))
    return rounded(out.select("roi", "label", "vec_id", "mean", "n_pixels"), "mean")


@query("e20_roi_map", "WITH " + _PIX + " SELECT 'roi_' || (pixel % 4) AS roi, label, round(avg(m), 7) AS mean, count(*) AS n_pixels FROM (SELECT label, pixel, avg(v) AS m FROM pix GROUP BY 1, 2) GROUP BY 1, 2")
def _(s, d):
    maps = pixels(s, d).groupBy("label", "pixel").agg(F.avg("v").alias("v"))
    return rounded(M.roi_mean(maps, _rois(s), ["label"], "pixel", "v").select("roi", "label", "mean", "n_pixels"), "mean")


@query("e21_roi_algebra", "WITH " + _PIX + " SELECT roi, round(avg(v), 7) AS mean FROM (SELECT DISTINCT CASE WHEN pixel % 4 IN (0, 1) THEN 'left' ELSE 'roi_' || (pixel % 4) END || CASE WHEN pixel // 8 < 3 THEN '-anterior' ELSE '-posterior' END AS roi, pixel FROM pix) JOIN pix USING (pixel) GROUP BY 1")
def _(s, d):
    rois = M.split_roi(M.merge_rois(_rois(s), {"roi_0": "left", "roi_1": "left"}), F.floor(F.col("pixel") / 8) < 3, ("anterior", "posterior"))
    return rounded(pixels(s, d).join(F.broadcast(rois), "pixel").groupBy("roi").agg(F.avg("v").alias("mean")), "mean")


@query("e22_combined_mask", "WITH " + _PIX + " SELECT vec_id, round(avg(v), 7) AS mean FROM pix WHERE pixel % 4 IN (1, 3) GROUP BY 1")
def _(s, d):
    mask = _rois(s).where(F.col("roi").isin("roi_1", "roi_3")).select("pixel").distinct()
    return rounded(pixels(s, d).join(F.broadcast(mask), "pixel").groupBy("vec_id").agg(F.avg("v").alias("mean")), "mean")


@query("e23_centre", "WITH " + _PIX + ", " + _BRIGHT + " SELECT 'bright' AS roi, round(avg(pixel % 8), 7) AS x, round(avg(pixel // 8), 7) AS y FROM br WHERE valid")
def _(s, d):
    names = s.createDataFrame([("bright",)], "roi string")
    return rounded(M.centre_of_mass(_bright(s, d).where("valid").select(F.lit("bright").alias("roi"), "pixel"), 8, names=names), "x", "y")


@query("e24_aligned_maps", "WITH " + _PIX + " SELECT label, (pixel // 8) * 8 + CASE WHEN label % 2 = 1 THEN 7 - (pixel % 8 + 1) ELSE pixel % 8 + 1 END AS pixel, round(avg(v), 7) AS v FROM pix WHERE pixel % 8 < 7 GROUP BY 1, 2")
def _(s, d):
    mean = pixels(s, d).groupBy("label", "pixel").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel", "v"))), lambda x: x["v"]).alias("pixels"))
    moved = M.aligned_maps(mean.withColumns({"affine": F.array(*[F.lit(float(x)) for x in (1, 0, 1, 0, 1, 0)]), "flip": F.col("label") % 2 == 1}), ["label"], (8, 8))
    long = moved.select("label", F.posexplode("pixels").alias("pixel", "v"))
    empty = F.when(F.col("label") % 2 == 1, F.col("pixel") % 8 == 7).otherwise(F.col("pixel") % 8 == 0)
    return rounded(long.where(~empty), "v")


@query(
    "e24_half_pixel",
    "WITH " + _PIX + ", m AS (SELECT label, pixel, avg(v) AS v FROM pix GROUP BY 1, 2) SELECT a.label, a.pixel, round((a.v + coalesce(b.v, 0)) / 2, 7) AS v FROM m a LEFT JOIN m b ON b.label = a.label AND a.pixel % 8 > 0 AND b.pixel = a.pixel - 1",
)
def _(s, d):
    mean = pixels(s, d).groupBy("label", "pixel").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel", "v"))), lambda x: x["v"]).alias("pixels"))
    moved = M.aligned_maps(mean.withColumns({"affine": F.array(*[F.lit(float(x)) for x in (1, 0, 0.5, 0, 1, 0)]), "flip": F.lit(False)}), ["label"], (8, 8))
    return rounded(moved.select("label", F.posexplode("pixels").alias("pixel", "v")), "v")


@query("e25_lengths", "WITH " + _PIX + ", c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY pixel) AS v FROM pix) SELECT vec_id, round(sum(v * v), 6) AS squares FROM c GROUP BY 1")
def _(s, d):
    pc = M.principal_components(frames(s, d), "vec_id", "pixels", 64, 64)[0]
    return pc.select("vec_id", F.round(F.aggregate("pc", F.lit(0.0), lambda t, x: t + x * x), 6).alias("squares"))


@query("e25_principal_components")
def _(s, d):
    return M.principal_components(frames(s, d), "vec_id", "pixels", 64, 10)[0]
