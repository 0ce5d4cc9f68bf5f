import pandas as pd
import pytest

from loomspan.operators.incremental import PopulateError, populate_each


def tables(spark):
    keys = spark.createDataFrame([(k,) for k in range(8)] + [(3,), (None,)], "k long")
    rows = spark.createDataFrame([(k, float(v)) for k in range(7) for v in range(k)] + [(99, 1.0)], "k long, v double")
    return keys, rows


def total(bad):
    def make(key, rows):
        if key["k"] in bad:
            raise ValueError(f"no result for {key['k']}")
        if key["k"] == 6:
            return rows.iloc[:0].assign(total=[], n=[])
        return pd.DataFrame({"total": [rows["v"].sum()], "n": [len(rows)]})

    return make


def test_a_failing_key_leaves_the_others(spark, tmp_path):
    keys, rows = tables(spark)
    at = {"target": f"file://{tmp_path}/t", "errors": f"file://{tmp_path}/e"}
    run = lambda bad, **how: populate_each(keys, rows, ["k"], total(bad), "total double, n long", **at, **how)
    made, errors = run({2, 5}, suppress_errors=True)
    assert sorted(tuple(r) for r in made.collect()) == [(k, sum(range(min(k, 7) if k < 7 else 0)) * 1.0, k if k < 7 else 0) for k in (0, 1, 3, 4, 7)]
    assert sorted(tuple(r) for r in errors.collect()) == [(k, 1, "ValueError", f"no result for {k}") for k in (2, 5)]
    # the second run tries the missing keys alone; one of them fails again
    made, errors = run({0, 1, 3, 5}, suppress_errors=True)
    assert sorted(r.k for r in made.collect()) == [0, 1, 2, 3, 4, 7]
    assert sorted((r.k, r.attempt) for r in errors.collect()) == [(2, 1), (5, 1), (5, 2)]
    with pytest.raises(PopulateError, match="1 keys failed.*no result for 5"):
        run({5})
    made, errors = run(set())
    assert sorted(r.k for r in made.collect()) == [0, 1, 2, 3, 4, 5, 7] and errors.count() == 4
    assert run(set())[0].count() == 7


def test_without_suppression_the_others_are_kept(spark, tmp_path):
    keys, rows = tables(spark)
    with pytest.raises(PopulateError):
        populate_each(keys, rows, ["k"], total({0}), "total double, n long", f"file://{tmp_path}/t", f"file://{tmp_path}/e")
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [1, 2, 3, 4, 5, 7]


def test_limit_and_order(spark, tmp_path):
    keys, rows = tables(spark)
    at = ("total double, n long", f"file://{tmp_path}/t", f"file://{tmp_path}/e")
    seen = [sorted(r.k for r in populate_each(keys, rows, ["k"], total(set()), *at, order="random", limit=3)[0].collect()) for _ in range(3)]
    assert [len(s) for s in seen] in ([3, 6, 7], [2, 5, 7], [3, 5, 7]) and set(seen[0]) < set(seen[1]) < set(seen[2])


def test_no_keys(spark, tmp_path):
    keys, rows = tables(spark)
    made, errors = populate_each(keys.where("false"), rows, ["k"], total(set()), "total double, n long", f"file://{tmp_path}/t", f"file://{tmp_path}/e")
    assert made.count() == 0 and errors.count() == 0
