import numpy as np
import pytest

from loomspan.operators import chunks, kernels


def series(spark, parts, extra="'x' note"):
    rows = [(k, i, float(v)) for k, values in parts.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, i long, v double").selectExpr("*", extra).repartition(4)


def by_key(df, column):
    out = {}
    for r in df.orderBy("k", "i").collect():
        out.setdefault(r.k, []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def direct(x, fs, cutoff, order, padlen=None):
    """The filter sample by sample."""
    sections, n = kernels.butterworth(fs, cutoff, order), len(x)
    pad = kernels.extension(n, order, padlen)
    s = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        first = s[0]
        for k, (b, a) in enumerate(sections):
            z0, z1 = kernels.settled(sections)[k] * first
            y = np.empty_like(s)
            for j, u in enumerate(s):
                y[j] = b[0] * u + z0
                z0, z1 = b[1] * u - a[0] * y[j] + z1, b[2] * u - a[1] * y[j]
            s = y
        s = s[::-1]
    return s[pad : pad + n]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kernel_equals_the_recurrence(order):
    x = np.random.default_rng(order).normal(size=333).cumsum()
    assert np.allclose(kernels.highpass(x, 20, 0.7, order), direct(x, 20, 0.7, order), atol=1e-10)
    assert np.allclose(kernels.highpass(np.stack([x, 2 * x]), 20, 0.7, order, 30)[1], 2 * direct(x, 20, 0.7, order, 30), atol=1e-10)


@pytest.mark.parametrize("samples,order,padlen", [(7, 2, None), (64, 2, None), (1000, 2, 40), (64, 3, 100), (10, 1, None)])
def test_chunks_equal_the_whole_series(spark, samples, order, padlen):
    rng = np.random.default_rng(samples)
    parts = {"a": rng.normal(size=500).cumsum() + 40, "b": rng.normal(size=65), "c": rng.normal(size=9), "d": [5.0, 7.0], "e": [3.0]}
    got = by_key(chunks.temporal_filter(series(spark, parts), ["k"], "i", "v", 20.0, 0.1, order=order, padlen=padlen, samples=samples), "filtered")
    for k, x in parts.items():
        x = np.array(x)
        assert np.abs(got[k] - (kernels.highpass(x - x.mean(), 20.0, 0.1, order, padlen) + x.mean())).max() < 1e-9


@pytest.mark.parametrize("samples,sigma", [(7, 1.0), (64, 5.0), (3, 6.0), (1000, 2.0)])
def test_smoothing_across_chunks(spark, samples, sigma):
    rng = np.random.default_rng(1)
    parts = {"a": rng.normal(size=200), "b": rng.normal(size=7), "c": [4.0], "d": rng.normal(size=64)}
    out = chunks.gauss1d(series(spark, parts), ["k"], "i", "v", sigma, "s", samples)
    assert out.columns == ["k", "i", "v", "note", "s"]
    got = by_key(out, "s")
    assert all(np.allclose(got[k], kernels.gauss(np.array(v), sigma), atol=1e-12) for k, v in parts.items())


def test_filter_and_smoothing_of_an_empty_table(spark):
    empty = series(spark, {"a": [1.0]}).where("false")
    assert chunks.temporal_filter(empty, ["k"], "i", "v", sigma=1.0).count() == 0


def test_no_task_holds_a_recording(spark):
    """Every group of samples is a chunk: the plan has no window and no group by the recording alone but the scan of summaries and the count."""
    out = chunks.temporal_filter(series(spark, {"a": np.arange(300.0)}), ["k"], "i", "v", sigma=1.0, samples=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "FlatMap" in line]
    assert len(groups) == 4 and "Window" not in plan
    alone = [line for line in groups if "CoGroups" not in line and "_chunk" not in line[line.index("[") : line.index("]")]]
    assert len(alone) == 1 and "scan(" in alone[0] and sum("CoGroups" in line for line in groups) == 1
