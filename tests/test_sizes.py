"""What shows only in large tables, at small scale: results at their edges, and plans that do not send rows again and again."""

import math
import os

import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalars
from loomspan.operators import imaging as M
from loomspan.operators import stats as H
from loomspan.operators.incremental import populate_each
from loomspan.plans import registry
from loomspan.sources import files as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_centre_of_a_region_without_pixels(spark, tmp_path):
    spark.range(4).selectExpr("id vec_id", "array_repeat(cast(-1 as float), 64) embedding", "cast(id % 2 as int) label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in registry.queries()["e23_centre"](spark, str(tmp_path)).collect()] == [("bright", None, None)]


@pytest.mark.parametrize("day", [0, 3_300_001, 8_999_999, -40_000])
def test_epochs_far_from_now_are_exact(spark, day):
    at = scalars.from_epoch(F.col("id") * 86400 + F.lit(0.5))
    assert spark.range(day, day + 1).select(F.unix_micros(at)).first()[0] == day * 86_400_000_000 + 500_000
    exact = spark.sql("select 1704067211.172425D s").select(F.unix_micros(scalars.from_epoch(F.col("s")))).first()[0]
    assert exact == 1_704_067_211_172_425


def test_a_large_session_is_exported_by_several_tasks(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "case when id < 900 then 'a' when id < 950 then 'b' end s", "map('k', id) m")
    B.export_bundle({"t": df}, str(tmp_path), ["s"], rows=100)
    parts = {d: len([f for f in os.listdir(tmp_path / "t" / d) if f.endswith(".parquet")]) for d in os.listdir(tmp_path / "t") if d.startswith("s=")}
    assert parts["s=a"] > 4 and parts["s=b"] == 1 and len(parts) == 3
    assert sorted((r.id, r.s, r.m["k"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == sorted((r.id, r.s, r.m["k"]) for r in df.collect())


def test_ranks_of_both_columns_take_one_shuffle_and_a_window_each(spark):
    rows = [("a", x, y) for x, y in [(1, 5.0), (1, 4.0), (2, 4.0), (3, 1.0), (3, None), (None, 1.0), (4, 0.0)]]
    out = H.spearman(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "x", "y")
    assert plan(out).count("Exchange") == 1 and plan(out).count("Window [") == 2
    r = out.first()
    a, b = [1.5, 1.5, 3, 4, 5], [5, 3.5, 3.5, 2, 1]
    dot = sum((p - 3) * (q - 3) for p, q in zip(a, b))
    assert r.n == 5 and abs(r.rho - dot / math.sqrt(sum((p - 3) ** 2 for p in a) * sum((q - 3) ** 2 for q in b))) < 1e-12


def test_products_of_a_reconstruction_are_not_shuffled(spark):
    u = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 1, None), (2, 7, 1.0), (0, 0, 1.0)], "pixel int, component int, u double")
    s = spark.createDataFrame([(0, 0, 5.0), (1, 0, 7.0), (0, 1, None), (1, 2, 4.0), (None, 3, 1.0)], "component int, frame int, s double")
    out = M.reconstruct(u, s)
    assert "SortMergeJoin" not in plan(out)
    join = u.join(s, "component").groupBy("pixel", "frame").agg(F.sum(F.col("u") * F.col("s")).alias("value"))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, join.collect()), key=key)


def test_frames_at_rest_are_sent_once_for_many_pixels(spark, monkeypatch):
    """300 pixels of each session, far apart: their frames at rest go to one part of a session, not to each stretch of 16 pixels."""
    sent = []
    apart = M._apart
    monkeypatch.setattr(M, "_apart", lambda df: (sent.append(df), apart(df))[1])
    e = spark.range(600).selectExpr("id % 2 label", "id frame", "array(id * 1.0D, sin(id)) sv")
    u = spark.range(600).selectExpr("id % 2 label", "id pixel", "array(cos(id), id * 0.1D) u")
    M.baseline_components(e, u, e.where("frame % 3 = 0").select("label", "frame"), ["label"], tile=16)
    assert sent[0].count() == 200


def test_keys_of_a_batch_do_not_meet(spark, tmp_path):
    """Two keys' columns, whole numbers that a double cannot hold in a key of which others give nulls, and one failure among them."""
    import pandas as pd

    rows = spark.createDataFrame([(k, f"x{k % 2}", v) for k in range(6) for v in range(k + 1)], "k long, g string, v long")

    def make(key, own):
        assert set(own["k"]) <= {key["k"]} and list(own.index) == list(range(len(own)))
        if key["k"] == 4:
            raise ValueError("no")
        return pd.DataFrame({"n": [None if key["k"] % 3 == 0 else 2**60 + len(own)], "t": [f"{key['g']}:{own['v'].sum()}"]})

    made, errors = populate_each(rows.select("k", "g").distinct().unionByName(spark.createDataFrame([(9, "z")], "k long, g string")), rows, ["k", "g"], make, "n long, t string", f"file://{tmp_path}/t", f"file://{tmp_path}/e", suppress_errors=True, keys_of_a_batch=100)
    want = [(k, f"x{k % 2}", None if k % 3 == 0 else 2**60 + k + 1, f"x{k % 2}:{k * (k + 1) // 2}") for k in (0, 1, 2, 3, 5)] + [(9, "z", None, "z:0")]
    assert sorted((r.k, r.g, r.n, r.t) for r in made.collect()) == want and [(r.k, r.kind, r.message) for r in errors.collect()] == [(4, "ValueError", "no")]


def test_samples_have_few_copies(spark):
    """Intervals of 21 widths, each twice as wide as the last: a copy of the samples for each width before."""
    from loomspan.operators import epochs as E

    iv = spark.range(21).selectExpr("1 k", "id", "id * 3.0D a", "id * 3.0D + pow(2.0D, id) b")
    s = spark.range(100).selectExpr("1 k", "id * 0.7D t")
    assert E.placed(s, iv, "t", "a", "b")[0].count() <= 7 * 100
    want = sorted((round(t * 0.7, 6), i) for t in range(100) for i in range(21) if i * 3.0 <= t * 0.7 <= i * 3.0 + 2.0**i)
    assert sorted((round(r.t, 6), r.id) for r in E.within(s, iv, ["k"], "t", "a", "b").collect()) == want
