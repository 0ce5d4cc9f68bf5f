import numpy as np
import pytest
from conftest import SMALL

from loomspan.llm import whitening as W


def plain(vectors, k):
    """n, exact deviations, whitened rows, shares of the variance, from numpy over the whole table."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, deviation, centred @ v / np.sqrt(e), e / np.trace(cov)


def compare(got, ids, vectors, k):
    n, deviation, white, share = plain(vectors, k)
    assert len(got) == n * k and set(got["n"]) == {n}
    for c in range(1, k + 1):
        own = got[got["component"] == c].set_index("vec_id" if "vec_id" in got else "id").loc[ids]
        assert own["deviation"].tolist() == deviation
        w = own["whitened"].to_numpy()
        sign = np.sign(w @ white[:, c - 1])
        assert np.allclose(w * sign, white[:, c - 1], atol=1e-6)
        assert np.allclose(own["explained"], share[c - 1], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-8


@pytest.mark.parametrize("height", [None, 7])
def test_whitening_equals_numpy(spark, monkeypatch, height):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    if height:
        monkeypatch.setattr(W, "block_height", lambda n, d: height)
        monkeypatch.setattr(W, "COLUMNS", 24)  # several columns of blocks
    compare(W.op13_whitening(spark, SMALL).toPandas(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def table(spark, rows):
    return W.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 x", "2 id", "3 n"))


def test_what_is_left_out(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [3e38, 0.0, 0.0, 0.0, 0.0]), (105, [1.0]), (106, [])]
    compare(W.whiten(table(spark, bad + good).repartition(3)).toPandas(), [i for i, _ in good], [v for _, v in good], 5)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 0.0])] * 3 + [(2, [0.0, 1.0])] * 2 + [(2, [0.5, 0.75])]
    got = W.whiten(table(spark, rows)).toPandas()
    assert len(got) == 12 and set(got["n"]) == {6} and got["id"].isna().sum() == 6


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 2.0])]
    got = W.whiten(table(spark, rows)).toPandas()
    assert got["deviation"].isna().any()  # does not fit in a long
    rows = [(1, [3e5, 0.0]), (2, [-3e5, 1.0]), (3, [0.0, 2.0])]
    compare(W.whiten(table(spark, rows)).toPandas(), [1, 2, 3], [v for _, v in rows], 2)


def test_no_variance(spark):
    got = W.whiten(table(spark, [(1, [1.0, 2.0])] * 4)).toPandas()
    assert len(got) == 8 and got[["whitened", "explained", "identity_error"]].isna().all().all() and set(got["deviation"]) == {0}
    flat = W.whiten(table(spark, [(i, [float(i), 1.0]) for i in range(5)])).toPandas()
    assert flat[flat["component"] == 2]["whitened"].isna().all() and flat[flat["component"] == 1]["whitened"].notna().all() and flat["identity_error"].iloc[0] < 1e-9


def test_empty_tables(spark):
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, []), (2, [])])).count() == 0
