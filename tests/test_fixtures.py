"""Hand-checked cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import epochs as E
from loomspan.operators import glm as L
from loomspan.operators import imaging as M
from loomspan.operators import kernels
from loomspan.operators import mixed as X
from loomspan.operators import sessions as S
from loomspan.operators import signal as G
from loomspan.operators import stats as H


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_trials(spark):
    log = [(0, "Baseline"), (1, "Servo in"), (2, "Cue"), (3, "Reward"), (4, "Baseline"), (5, "Servo in"), (6, "Cue"), (7, "Fail"), (8, "End")]
    df = spark.createDataFrame([(1, float(t), e) for t, e in log], "k int, t double, event string")
    out = G.trials_from_events(df, ["k"], "t", "event", {"t_start": "Baseline", "t_servo_in": "Servo in", "t_cue": "Cue"}, "Fail", "Autoreward", "Reward")
    got = [tuple(r) for r in out.orderBy("trial_id").collect()]
    assert got == [(1, 0, 0.0, 1.0, 2.0, 3.0, 4.0, True, False), (1, 1, 4.0, 5.0, 6.0, 7.0, 8.0, False, False)]


def test_runs_drop_last(spark):
    df = series(spark, [0, 1, 1, 0, 1, 0, 1]).withColumn("on", F.col("v") > 0.5)
    assert [(r.i, r.run_id) for r in G.runs(df, ["k"], ["i"], "on", drop_last=True).orderBy("i").collect()] == [(1, 1), (2, 1), (4, 2)]


def test_fill_gaps(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 4, 5)], "k int, t double")
    assert [r.t for r in G.fill_gaps(df, ["k"], "t").where("added").collect()] == [3.0]


def test_normalised_days_and_phase(spark):
    df = spark.createDataFrame([(1, d) for d in (-9, -5, -2, 0, 3)], "m int, days int")
    assert column(S.normalise_days(df, ["m"]), "norm", "days") == [-3, -2, -1, 0, 3]
    cases = spark.createDataFrame([(0, 0.85, -1, -1), (1, 0.5, -1, -1), (2, 0.5, 8, 8), (3, 0.5, 11, 11)], "i int, p double, d int, n int")
    assert column(cases.withColumn("phase", S.phase("p", "d", "n")), "phase") == ["Expert", "Learning", "Early", "Late"]


def test_closing(spark):
    for given, want in (([0, 1, 0, 1, 0, 0], [0, 1, 1, 1, 0, 0]), ([1, 1, 0, 0], [0, 1, 0, 0])):
        df = series(spark, given).withColumn("on", F.col("v") > 0.5)
        once = G.closing(df, ["k"], ["i"], "on", 3, "c")
        assert [int(x) for x in column(once, "c")] == want


def test_rewarded_epochs(spark):
    ep = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.0), (1, 2, 9.0)], "k int, epoch_id int, start_time double")
    rewards = spark.createDataFrame([(1, 4.005), (1, 8.0)], "k int, t double")
    assert sorted(r.epoch_id for r in E.rewarded_epochs(rewards, ep, ["k"]).collect()) == [0, 1]


def test_crossings(spark):
    df = series(spark, [1, 1, -1, -1, 1]).withColumn("b", F.lit(0.0))
    assert column(G.crossings(df, ["k"], ["i"], "v", "b"), "crossing") == [1, 0, -2, 0, 2]


def test_lag_wrap(spark):
    df = series(spark, [1, 0, 0, 0])
    assert column(L.lag_expand(df, ["k"], "i", "v", [1]), "x") == [0, 0, 0, 1]
    assert column(L.lag_expand(df, ["k"], "i", "v", [-1], wrap=False), "x") == [0, 1, 0, 0]


def test_kfold(spark):
    folds = column(L.kfold(series(spark, range(7)), ["k"], ["i"], 3), "fold")
    assert folds == [0, 0, 0, 1, 1, 2, 2]


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.5))], "i int, p double")
    assert np.allclose(column(H.bh_adjust(df, "p"), "p_adjusted"), [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_absent_cell_is_zero(spark):
    df = spark.createDataFrame([("s1", "A", 4.0), ("s2", "B", 1.0)], "s string, c string, v double")
    got = {r.c: r.mean for r in H.mean_absent_zero(df, "s", [], ["c"], "v").collect()}
    assert got == {"A": 2.0, "B": 0.5}


def test_interp_is_identity_at_knots_and_clamped(spark):
    knots = spark.createDataFrame([(1, 0.0, 5.0), (1, 2.0, 9.0)], "k int, t double, v double")
    at = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.0, 2.0, 3.0)], "k int, t double")
    assert column(G.interp(at, knots, ["k"], "t", "v"), "v", "t") == [5, 5, 7, 9, 9]
    assert column(G.interp(at, knots, ["k"], "t", "v", method="nearest"), "v", "t") == [5, 5, 5, 9, 9]


def test_savgol_keeps_a_parabola(spark):
    v = [0.5 * i * i - 3 * i + 2 for i in range(12)]
    assert np.allclose(column(G.savgol(series(spark, v), ["k"], ["i"], "v", 7, 2, "s"), "s"), v)


def test_peaks():
    v = np.array([0, 1, 0, 3, 3, 0, 2, 0, 5, 0], float)
    assert kernels.peaks(v).tolist() == [1, 3, 6, 8]
    assert kernels.peaks(v, distance=3).tolist() == [3, 8]
    assert kernels.peaks(v, prominence=2.5).tolist() == [3, 8]


def test_highpass_removes_constants_and_keeps_fast():
    t = np.arange(2000) / 20
    assert np.abs(kernels.highpass(np.full(400, 3.0), 20, 0.1)).max() < 1e-9
    fast = np.sin(2 * np.pi * 2 * t)
    assert np.abs(kernels.highpass(fast, 20, 0.1)[700:1300] - fast[700:1300]).max() < 0.02


def test_phase_shift_and_warp():
    img = kernels.blur(np.random.default_rng(1).normal(size=(32, 32)), 1.5)
    x, y = kernels.phase_shift(img, np.roll(img, (3, -2), (0, 1)), 4)
    assert abs(x - 2) < 0.3 and abs(y + 3) < 0.3
    moved = kernels.warp(img, np.array([[1, 0, 2.0], [0, 1, 1.0]]))
    assert np.allclose(moved[5:, 5:], img[4:-1, 3:-2])


def test_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(3)
    x, fold = rng.normal(size=(90, 3)), np.arange(90) % 3
    y = x @ rng.normal(size=(3, 2)) + 0.1 * rng.normal(size=(90, 2)) + 4
    df = spark.createDataFrame([(int(f), a.tolist(), b.tolist()) for f, a, b in zip(fold, x, y)], "fold int, x array<double>, y array<double>")
    fit = L.ridge_cv(df, 3, 2, [0.5])
    for f in range(3):
        a, b = x[fold != f], y[fold != f]
        am, bm = a - a.mean(0), b - b.mean(0)
        want = np.linalg.solve(am.T @ am + 0.5 * np.eye(3), am.T @ bm)
        assert np.allclose(fit["coefficients"][f], want)
        pred = x[fold == f] @ want + b.mean(0) - a.mean(0) @ want
        own = y[fold == f]
        assert np.isclose(fit["r2"][f], 1 - ((own - pred) ** 2).sum() / ((own - own.mean(0)) ** 2).sum())


@pytest.mark.parametrize("tile", [1, 4, 5, 100])
def test_frames_to_pixels_moves_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    rows = [(k, f, rng.normal(size=11).tolist()) for k in ("a", "b") for f in range(6)]
    frames = spark.createDataFrame(rows, "k string, frame int, pixels array<double>").repartition(3)
    out = M.frames_to_pixels(frames, ["k"], tile)
    got = {(r.k, r.pixel): list(r.series) for r in out.collect()}
    assert got == {(k, p): [v[p] for k2, _, v in rows if k2 == k] for k in ("a", "b") for p in range(11)}
    assert M.tiled(frames, ["k"], tile).count() == len(rows) * -(-11 // tile)
    assert M.frames_to_pixels(frames.where("false"), ["k"]).count() == 0


def test_svd_projector(spark):
    x = np.random.default_rng(4).normal(size=(60, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, a array<double>")
    u, s, v = M.truncated_svd(df, "i", "a", 6, 3)
    got = np.array([r.u for r in u.orderBy("i").collect()])
    full = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, full[1][:3]) and np.allclose((got * s) @ v.T, (full[0][:, :3] * full[1][:3]) @ full[2][:3])


def test_svd_of_a_wide_column_and_explained_variance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 12)) @ np.diag(0.5 ** np.arange(12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 0.3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, a array<double>")
    full = np.linalg.svd(x, full_matrices=False)
    _, s, v = M.truncated_svd(df, "i", "a", 12, 3, exact=0, extra=3, passes=6)
    assert np.allclose(s, full[1][:3], rtol=1e-4) and np.allclose(np.abs(np.sum(v * full[2][:3].T, axis=0)), 1, atol=1e-4)
    want = (full[1][:3, None] * full[2][:3]).var(1) / x.var(1).sum()
    assert np.allclose(M.explained_variance(df, "a", s, v), want, rtol=1e-3)
    values, _, n, mean = M.leading_axes(df, "a", 12, 3, centred=True, exact=0, extra=3, passes=6)
    assert n == 80 and np.allclose(mean, x.mean(0)) and np.allclose(values, np.linalg.svd(x - x.mean(0))[1][:3] ** 2, rtol=1e-4)


def test_highpass_of_many_series_and_orders():
    x = np.random.default_rng(7).normal(size=(3, 80)).cumsum(1)
    for order in (1, 2, 3, 4):
        assert np.allclose(kernels.highpass(x, 20, 1.0, order), [kernels.highpass(r, 20, 1.0, order) for r in x])
        t = np.arange(6000) / 20  # forward and backward, a sine at the cutoff keeps half of its size whatever the order
        middle = kernels.highpass(np.sin(2 * np.pi * t), 20, 1.0, order, padlen=0)[2500:3500]
        assert abs(np.abs(middle).max() - 0.5) < 1e-3
    assert kernels.highpass(np.zeros((2, 1)), 20, 1.0).shape == (2, 1)


def test_area_resize_by_any_ratio():
    img = np.arange(35.0).reshape(5, 7)
    small = kernels.area_mean(img, 2, 3)
    assert np.isclose(small.mean(), img.mean()) and np.isclose(small[0, 0], (img[:2, :2].sum() + img[:2, 2].sum() / 3 + img[2, :2].sum() / 2 + img[2, 2] / 6) / (2.5 * 7 / 3))
    assert np.allclose(kernels.area_mean(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.allclose(kernels.area_mean(np.arange(4.0).reshape(2, 2), 3, 4), [[0, 0, 1, 1], [1, 1, 2, 2], [2, 2, 3, 3]])  # larger: a row in between is half of each


def test_mixed_contrast_without_subject_effect_is_difference_of_means(spark):
    rng = np.random.default_rng(5)
    rows = [("r", f"m{m}", "A" if m % 2 else "B", "p", float(rng.normal() + (m % 2))) for m in range(12) for _ in range(8)]
    df = spark.createDataFrame(rows, "roi string, mouse string, g string, p string, y double")
    got = X.mixed_contrasts(df, ["roi"], "y", "g", "p", "mouse").collect()[0]
    a, b = ([r[4] for r in rows if r[2] == x] for x in "AB")
    assert abs(got.estimate - (np.mean(a) - np.mean(b))) < 0.05 and 0 <= got.p_value <= 1 and got.low < got.estimate < got.high


@pytest.mark.parametrize("channels", [1, 3])
def test_shape_distance_equals_the_direct_sum(spark, channels):
    rng = np.random.default_rng(channels)
    template = {k: rng.normal(size=(n, channels)).cumsum(0) for k, n in (("a", 200), ("b", 7))}
    events = {(k, e): rng.normal(size=(n, channels)) - 3 * (e == 2) for k, n in (("a", 200), ("b", 12)) for e in range(4)}
    events["b", 9] = np.zeros((5, channels))
    names = [f"v{c}" for c in range(channels)]
    schema = ", ".join(f"{n} double" for n in names)
    t = spark.createDataFrame([(k, i, *map(float, v)) for k, x in template.items() for i, v in enumerate(x)], f"k string, at int, {schema}")
    e = spark.createDataFrame([(k, j, i - 3, *map(float, v)) for (k, j), x in events.items() for i, v in enumerate(x)] + [("z", 0, 0, *[1.0] * channels)], f"k string, e int, at int, {schema}").repartition(3)
    got = {(r.k, r.e): r.distance for r in H.sbd_to_template(e, t, ["k"], "e", "at", names if channels > 1 else "v0").collect()}
    assert got.pop(("b", 9)) is None and got.keys() == set(events) - {("b", 9)}
    for (k, j), d in got.items():
        x, y = events[k, j], template[k]
        each = [1 - np.correlate(x[:, c], y[:, c], "full").max() / np.sqrt((x[:, c] ** 2).sum() * (y[:, c] ** 2).sum()) for c in range(channels)]
        assert abs(d - np.mean(each)) < 1e-9
    assert H.sbd_to_template(e.where("false"), t, ["k"], "e", "at", "v0").count() == 0


@pytest.mark.parametrize("key", [["k"], []])
def test_baseline_of_components(spark, key):
    rng = np.random.default_rng(len(key))
    want_sv, want_base, comp, us, still = {}, {}, [], [], []
    valid = {p: p % 5 != 1 for p in range(23)}
    for k in ("a", "b") if key else ("a",):
        u, sv = rng.normal(size=(23, 3)), rng.normal(size=(3, 17)) + 2
        rest = [f for f in range(17) if f % 3 == 0]
        base = np.median((u @ sv)[:, rest], axis=1)
        diff = (u @ sv - base[:, None]) * np.array([valid[p] for p in range(23)])[:, None]
        out = u.T @ diff
        want_sv |= {(k, f): out[:, f] for f in range(17)}
        want_base |= {(k, p): base[p] for p in range(23)}
        comp += [(k, f, sv[:, f].tolist()) for f in range(17)]
        us += [(k, p, u[p].tolist()) for p in range(23)]
        still += [(k, f) for f in rest]
    comp, us, still = (spark.createDataFrame(r, s).repartition(3) for r, s in ((comp, "k string, frame int, sv array<double>"), (us, "k string, pixel int, u array<double>"), (still, "k string, frame int")))
    mask = spark.createDataFrame(list(valid.items()), "pixel int, valid boolean")
    drop = (lambda df: df) if key else (lambda df: df.drop("k"))
    out, base = M.baseline_components(drop(comp), drop(us), drop(still), key, mask, tile=10, frames=4)
    name = lambda r: r.k if key else "a"
    got = {(name(r), r.frame): r.sv for r in out.collect()}
    assert got.keys() == want_sv.keys() and all(np.allclose(got[k], v) for k, v in want_sv.items())
    got = {(name(r), r.pixel): r.baseline for r in base.collect()}
    assert got.keys() == want_base.keys() and all(np.isclose(got[k], v) for k, v in want_base.items())
    if key:
        assert M.baseline_components(comp, us, still.where("false"), key, mask)[0].count() == 0


def test_map_median_of_tiles(spark):
    rows = [("a", [1.0, None, float("nan"), 4.0, 5.0]), ("a", [3.0, 2.0, float("nan"), 8.0]), ("a", None), ("b", []), ("b", [7.0])]
    got = sorted((r.k, r.pixel, r["median"]) for r in H.map_average(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v", "median", tile=2).collect())
    assert got == [("a", 0, 2.0), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, 5.0), ("b", 0, 7.0)]


def test_readers(spark, tmp_path):
    from loomspan.sources import files as B

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{\n "Sampling rate": 2,\n "Reward time": 5\n}')
    row = B.read_params(spark, str(tmp_path / "p"), {"Sampling rate": "sampling_rate", "Reward time": "reward_time"}).first()
    assert (row.sampling_rate, row.reward_time) == (2000, 5)
    (tmp_path / "g.csv").write_text("ctrl, m1, m2,,m3\n\nstroke,m4\n")
    assert [tuple(r) for r in B.read_members(spark, str(tmp_path / "g.csv")).orderBy("group", "place").collect()] == [("ctrl", 0, "m1"), ("ctrl", 1, "m2"), ("ctrl", 3, "m3"), ("stroke", 0, "m4")]
    for animal in ("a1", "a2"):
        (tmp_path / "m" / animal).mkdir(parents=True)
        (tmp_path / "m" / animal / "s1.txt").write_text("; head 1 2\n 7 1.5 2.5 0\n\n8\t3 4\n")
    got = sorted(tuple(r) for r in B.read_markers(spark, str(tmp_path / "m")).collect())
    assert got == [("a1", "s1.txt", 1.5, 2.5), ("a1", "s1.txt", 3.0, 4.0), ("a2", "s1.txt", 1.5, 2.5), ("a2", "s1.txt", 3.0, 4.0)]
    for root, names in (("r1", ["x/a.csv"]), ("r2", ["x/a.csv", "y/b.csv"])):
        for n in names:
            (tmp_path / root / n).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / root / n).write_text("1")
    found = B.discover(spark, [f"file://{tmp_path}/r1", f"file://{tmp_path}/r2"], "*.csv")
    assert sorted((r.relative, "/r1/" in r.path) for r in found.collect()) == [("x/a.csv", True), ("y/b.csv", False)]


def test_session_id(spark):
    df = spark.createDataFrame([("u", 7, dt.date(2024, 3, 5), 2)], "user string, mouse int, day date, num int")
    assert df.select(S.session_id("user", "mouse", "day", "num")).first()[0] == "session_u_M007_2024-03-05_02"


def test_numbering_without_groups(spark):
    from loomspan.operators import algebra as A

    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("v"))
    assert [(r.v, r.n) for r in A.numbered(rows, ["v"], "n").orderBy("v").collect()] == [(k, k) for k in range(500)]
    table = spark.createDataFrame([(4,), (9,)], "c long")
    got = A.next_counter(table, rows, ["v"], "c").orderBy("v").collect()
    assert [r.c for r in got] == list(range(10, 510))
    assert [r.c for r in A.next_counter(table.where("false"), rows.limit(3), ["v"], "c").orderBy("v").collect()] == [0, 1, 2]
    folds = L.kfold(rows, [], ["v"], 3).groupBy("fold").count().orderBy("fold").collect()
    assert [(r["fold"], r["count"]) for r in folds] == [(0, 167), (1, 167), (2, 166)]


def test_p_values_of_student(spark):
    """Published two-sided critical values of t."""
    from loomspan.operators import stats

    rows = [(12.706205, 1.0, 0.05), (2.228139, 10.0, 0.05), (3.169273, 10.0, 0.01), (1.959964, 1e7, 0.05), (0.0, 5.0, 1.0), (-2.085963, 20.0, 0.05)]
    df = spark.createDataFrame(rows, "t double, dof double, want double")
    assert all(abs(r.p - r.want) < 1e-6 for r in df.withColumn("p", stats.t_p_value(df.t, df.dof)).collect())
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    r = stats.t_test(two, "g", "v", "a", "b").first()
    assert abs(r.t + 1.2247449) < 1e-6 and r.dof == 4 and abs(r.p_value - 0.2878641) < 1e-6


def test_a_product_of_two_large_tables_is_refused(spark):
    from loomspan.operators import algebra

    a, b = spark.range(30).toDF("a"), spark.range(30).toDF("b")
    assert algebra.natural_join(a, b).count() == 900 and algebra.natural_join(a, b, most=29 + 1).count() == 900
    with pytest.raises(ValueError):
        algebra.natural_join(a, b, most=10)
