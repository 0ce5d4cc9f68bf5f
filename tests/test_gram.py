import numpy as np
import pytest

from loomspan.operators import glm as L
from loomspan.operators import gram as R
from loomspan.operators import imaging as M


def recording(spark, x, y, key="a"):
    rows = [(key, i, x[i].tolist(), y[i].tolist()) for i in range(len(x))]
    return spark.createDataFrame(rows, "k string, i long, x array<double>, y array<double>").repartition(3)


def explicit(x, lags):
    return np.stack([np.roll(x[:, j], -lag) for j, own in enumerate(lags) for lag in own], 1)


def grams_of(z, y, folds):
    starts = R.fold_starts(len(z), folds)
    whole = np.hstack([np.ones((len(z), 1)), z, y])
    return {f: whole[a:b].T @ whole[a:b] for f, (a, b) in enumerate(zip(starts, starts[1:]))}


@pytest.mark.parametrize("samples,n,lags", [(50, 203, [list(range(-6, 7)), list(range(-3, 5))]), (1000, 97, [[0], [-2, 5], [3]]), (17, 60, [list(range(0, 30))]), (13, 20, [list(range(-25, 26))])])
def test_lagged_grams_equal_the_explicit_matrix(spark, samples, n, lags):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, len(lags))).cumsum(0), rng.normal(size=(n, 3))
    got, p, q = R.lagged_grams(recording(spark, x, y), ["k"], "i", "x", "y", lags, 4, samples)
    want = grams_of(explicit(x, lags), y, 4)
    assert (p, q) == (sum(map(len, lags)), 3) and got.keys() == want.keys()
    for f in want:
        assert np.allclose(got[f], want[f], rtol=1e-9, atol=1e-7)


def test_ridge_on_many_lags(spark):
    """Four signals at 121 lags: every fold's sums, scores, coefficients and predictions as from the whole matrix, and no row for a lag."""
    rng = np.random.default_rng(0)
    n, lags = 900, [list(range(-60, 61))] * 4
    x = rng.normal(size=(n, 4))
    z = explicit(x, lags)
    y = z @ rng.normal(size=(z.shape[1], 2)) * 0.1 + rng.normal(size=(n, 2)) + 3
    rows = recording(spark, x, y)
    got = L.lagged_ridge_cv(rows, ["k"], "i", "x", "y", lags, 5, [1.0, 100.0])
    want = L.ridge_of_grams(grams_of(z, y, 5), z.shape[1], [1.0, 100.0])
    assert got["alpha"] == want["alpha"] and np.allclose(got["scores"], want["scores"])
    assert all(np.allclose(got["coefficients"][f], want["coefficients"][f], atol=1e-8) for f in range(5))
    predicted = np.array([r.predicted for r in R.lagged_predict(rows, ["k"], "i", "x", lags, 5, got, 128).orderBy("i").collect()])
    starts = R.fold_starts(n, 5)
    for f in range(5):
        a, b = starts[f], starts[f + 1]
        assert np.allclose(predicted[a:b], z[a:b] @ want["coefficients"][f] + want["intercepts"][f], atol=1e-7)
    sent = R.reached(rows, ["k"], "i", -60, 60, 128)
    assert sent.count() == sum(min(n, (c + 1) * 128) - c * 128 + 120 for c in range(8))


def test_recordings_are_lagged_apart(spark):
    rng = np.random.default_rng(3)
    lags = [[-1, 0, 2], [1]]
    parts = {k: (rng.normal(size=(n, 2)), rng.normal(size=(n, 1))) for k, n in (("a", 31), ("b", 40))}
    rows = recording(spark, *parts["a"]).unionByName(recording(spark, *parts["b"], key="b"))
    got = R.lagged_grams(rows, ["k"], "i", "x", "y", lags, 3, 8)[0]
    want = [grams_of(explicit(x, lags), y, 3) for x, y in parts.values()]
    assert all(np.allclose(got[f], want[0][f] + want[1][f]) for f in range(3))


def test_wide_models_move_blocks(spark):
    """364 columns and 100 outputs: two blocks of packed sums for each task and fold, and the sums of numpy."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(240, 364)), rng.normal(size=(240, 100))
    df = spark.createDataFrame([(i % 2, x[i].tolist(), y[i].tolist()) for i in range(240)], "fold int, x array<double>, y array<double>").repartition(3)
    got = R.fold_grams(df, 364, 100)
    z = np.hstack([np.ones((240, 1)), x, y])
    assert all(np.allclose(got[f], z[f::2].T @ z[f::2]) for f in (0, 1))
    seen = R.partial_sums(df.select("x"), lambda b: {0: R.packed(R.stacked(b.column(0)).T @ R.stacked(b.column(0)))})
    assert seen.count() == 3 * -(-(364 * 365 // 2) // R.BLOCK)
    assert R.tree_sum(seen.where("false")) == {}


def test_summed_products_of_frames(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 7))
    df = spark.createDataFrame([(r.tolist(),) for r in v], "v array<double>").repartition(4)
    assert np.allclose(M.gram(df, "v", 7), v.T @ v) and np.allclose(M.gram(df.where("false"), "v", 7), 0)


def test_parts_of_a_prediction(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 2))
    rows = spark.createDataFrame([(i, i // 10, x[i].tolist(), y[i].tolist(), (y[i] - 2).tolist()) for i in range(30)] + [(99, None, x[0].tolist(), y[0].tolist(), y[0].tolist())], "i int, fold int, x array<double>, y array<double>, still array<double>")
    fit = L.ridge_cv(rows.where("fold is not null"), 4, 2, [1.0])
    out = L.parts_of_prediction(rows, fit, {"first": [0, 1], "rest": [2, 3]}, "y", "still").orderBy("i").collect()
    for r in out[:-1]:
        b, c = fit["coefficients"][r.fold], fit["intercepts"][r.fold]
        own = x[r.i]
        assert np.allclose(r["first"], own[:2] @ b[:2]) and np.allclose(r["rest"], own[2:] @ b[2:]) and np.allclose(r["intercept"], c - 2)
        assert np.allclose(r["total"], own @ b + c - 2) and np.allclose(r["true"], y[r.i])
    assert out[-1]["total"] is None and out[-1]["first"] is None
    assert np.allclose([r.predicted for r in L.predict(rows.where("i < 30"), fit, [1]).orderBy("i").collect()], [x[i, 1:2] @ fit["coefficients"][i // 10][1:2] + fit["intercepts"][i // 10] for i in range(30)])
