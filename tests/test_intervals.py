import math
from collections import Counter

import numpy as np
import pytest

from loomspan.operators import epochs as E


def tables(spark, samples, intervals):
    a = spark.createDataFrame(samples, "k string, t double, s int").repartition(3)
    return a, spark.createDataFrame(intervals, "k string, a double, b double, e int").repartition(2)


def cases(whole):
    rng = np.random.default_rng(int(whole))
    scale = lambda x: float(round(x)) if whole else float(x)
    samples = [("xy"[i % 2], scale(rng.uniform(-50, 5000)), i) for i in range(400)] + [("x", 16.0, 1000), ("x", 32.0, 1001), ("y", 1.7e9 + 0.25, 1002), ("x", None, 1003)]
    intervals = []
    for e in range(120):
        a = scale(rng.uniform(-60, 5000))
        intervals.append(("xyz"[e % 3], a, a + scale(float(rng.choice([0, 0.001, 1, 3, 40, 1000])) * rng.uniform(0.5, 2)), e))
    intervals += [("x", 16.0, 32.0, 200), ("x", 16.0, 16.0, 201), ("x", 40.0, 30.0, 202), ("y", 1.7e9, 1.7e9 + 1, 203), ("x", None, 5.0, 204), ("x", 15.999, 32.001, 205), ("x", -1e4, 1e4, 206)]
    return samples, intervals


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("closed", ["both", "left", "right"])
def test_range_join_equals_brute_force(spark, whole, closed):
    samples, intervals = cases(whole)
    low = (lambda t, a: t >= a) if closed != "right" else (lambda t, a: t > a)
    high = (lambda t, b: t <= b) if closed != "left" else (lambda t, b: t < b)
    want = Counter((s, e) for k, t, s in samples for j, a, b, e in intervals if k == j and t is not None and a is not None and a <= b and low(t, a) and high(t, b))
    out = E.within(*tables(spark, samples, intervals), ["k"], "t", "a", "b", closed)
    assert out.columns == ["k", "t", "s", "a", "b", "e"]
    assert Counter((r.s, r.e) for r in out.collect()) == want and len(want) > 100


def test_cells_are_few(spark):
    samples, intervals = cases(False)
    a, b = E.placed(*tables(spark, samples, intervals), "t", "a", "b")
    levels = {r._level for r in b.select("_level").distinct().collect()}
    lengths = [y - x for _, x, y, _ in intervals if x is not None and y > x]
    assert len(levels) <= math.log2(max(lengths) / 2**E.FINEST) + 2
    assert max(Counter(r.e for r in b.collect()).values()) <= 2
    assert set(Counter(r.s for r in a.collect()).values()) == {len(levels)}


def test_empty_sides(spark):
    samples, intervals = tables(spark, *cases(False))
    assert E.within(samples, intervals.where("false"), ["k"], "t", "a", "b").count() == 0
    assert E.within(samples.where("false"), intervals, ["k"], "t", "a", "b").count() == 0
