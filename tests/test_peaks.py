import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.operators import kernels, peaks
from loomspan.operators.chunks import in_groups
from loomspan.plans import registry


def waves(seed):
    """Series with plateaus, runs that rise or fall for long, equal heights, and one sample alone."""
    rng = np.random.default_rng(seed)
    return {
        "walk": rng.normal(size=160).cumsum(),
        "plateaus": rng.integers(0, 4, 150).astype(float).repeat(rng.integers(1, 6, 150))[:170],
        "flat": np.full(40, 2.0),
        "down": np.concatenate([np.arange(60.0)[::-1], [70.0, 3.0, 5.0, 5.0, 4.0]]),
        "stairs": np.floor(np.arange(90) / 7) + (np.arange(90) % 7 == 3),
        "saw": np.where(np.arange(120) % 2 == 0, 0.0, np.arange(120.0)),
        "fall": np.where(np.arange(120) % 2 == 0, 0.0, 500 - np.arange(120.0)),
        "one": np.array([3.0]),
        "noise": rng.normal(size=200).round(1),
    }


def frame_of(spark, series, apart=1):
    rows = [(k, 5 + apart * i, float(x)) for k, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, frame long, v double").repartition(3)


@pytest.mark.parametrize("samples,distance,prominence", [(7, 1, 0.0), (7, 3, 0.0), (11, 4, 1.0), (50, 10, 0.5), (3, 2, 2.0), (1000, 5, 1.0), (1, 3, 1.0)])
def test_peaks_in_chunks_equal_the_kernel(spark, samples, distance, prominence):
    series = waves(samples)
    got = {k: [] for k in series}
    for r in peaks.find_peaks(frame_of(spark, series), ["k"], "frame", "v", distance, prominence, samples).orderBy("k", "pos").collect():
        got[r.k].append(r.pos)
        assert r.frame == 5 + r.pos and r.height == series[r.k][r.pos]
    assert got == {k: kernels.peaks(v, distance, prominence).tolist() for k, v in series.items()}


def test_frames_with_gaps(spark):
    series = waves(9)
    got = peaks.find_peaks(frame_of(spark, series, 3), ["k"], "frame", "v", 4, 0.3, 20).orderBy("k", "pos").collect()
    assert [(r.k, r.pos) for r in got] == [(k, p) for k in sorted(series) for p in kernels.peaks(series[k], 4, 0.3)] and all(r.frame == 5 + 3 * r.pos for r in got)


def test_stacks_merge():
    rng = np.random.default_rng(4)
    for _ in range(50):
        v = rng.integers(0, 9, 30).astype(float)
        for cut in (1, 9, 29):
            a, b = v[:cut], v[cut:]
            whole, merged = peaks.seen_from_right(v), peaks.behind(*peaks.seen_from_right(b), peaks.seen_from_right(a), b.max(), b.min())
            for q in range(9):  # the same lowest value in front of the first higher one, where there is one
                low = lambda s, q=q: s[1][np.searchsorted(s[0], q, side="right")] if len(s[0]) and s[0][-1] > q else None
                assert low(whole) == low(merged) or min(low(whole), q) == min(low(merged), q)


def test_an_undecided_peak_is_never_wrong():
    rng = np.random.default_rng(7)
    for _ in range(200):
        pos = np.unique(rng.integers(0, 60, 20))
        height = rng.integers(0, 5, len(pos)).astype(float)
        want = set(pos[peaks.spaced(pos, height, 6)[0]])
        inside = (pos >= 20) & (pos < 45)
        kept, unknown = peaks.spaced(pos[inside], height[inside], 6, 19, 45)
        own = set(pos[inside][kept]), set(pos[inside][unknown])
        assert own[0] <= want and want & set(pos[inside]) <= own[0] | own[1]


def test_sub_epochs_of_an_empty_table(spark):
    e = frame_of(spark, {"k": np.arange(9.0)})
    epochs = spark.createDataFrame([("k", 0, 5, 14)], "k string, epoch_id int, start_frame long, end_frame long")
    assert [tuple(r)[:5] for r in peaks.split_at_minima(e, epochs, ["k"], "frame", "v", 2, 0.1).collect()] == [("k", 0, 0, 5, 13)]
    assert peaks.split_at_minima(e, epochs.where("false"), ["k"], "frame", "v", 2, 0.1).count() == 0


def test_short_groups_share_a_call(spark):
    """Groups of two or three rows, some over the borders of batches, and one that is longer than a batch: few calls, whole groups, in order."""
    df = spark.range(3000).selectExpr("nullif(id % 1200, 7) k", "3000 - id i").unionByName(spark.range(900).selectExpr("5000L k", "id * 7 % 900 i")).repartition(5)

    def make(table, starts):
        ends = [*starts[1:].tolist(), table.num_rows]
        k, i = table.column("k").to_pylist(), table.column("i").to_pylist()
        good = [len(set(k[a:b])) == 1 and i[a:b] == sorted(i[a:b]) for a, b in zip(starts, ends)]
        return pa.table({"k": pa.array([k[a] for a in starts], pa.int64()), "n": pa.array(np.subtract(ends, starts)), "good": good, "call": starts == 0})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    try:
        got = in_groups(df, ["k"], ["i"], make, "k long, n long, good boolean, call boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.k: r.n for r in df.groupBy("k").agg(F.count("i").alias("n")).collect()}
    assert {r.k: r.n for r in got} == want and len(got) == len(want) == 1201 and all(r.good for r in got)
    assert sum(r.call for r in got) < 30


def test_no_task_calls_python_for_each_chunk(spark):
    e = frame_of(spark, {"k": np.arange(40.0) % 3})
    epochs = spark.createDataFrame([("k", 0, 5, 45)], "k string, epoch_id int, start_frame long, end_frame long")
    for out in (peaks.find_peaks(e, ["k"], "frame", "v", 3, 0.0, 4), peaks.split_at_minima(e, epochs, ["k"], "frame", "v", 3, 0.5, 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "GroupsInArrow" not in plan


def test_ends_of_epochs_come_with_their_minima(spark):
    """Samples meet their epochs twice, for summaries and for peaks, and not once more for the ends."""
    e = frame_of(spark, {"k": np.arange(40.0) % 7, "j": np.array([4.0])}, 3)
    epochs = spark.createDataFrame([("k", 0, 5, 60), ("k", 1, 50, 125), ("k", 2, 8, 11), ("j", 0, 0, 9)], "k string, epoch_id int, start_frame long, end_frame long")
    out = peaks.split_at_minima(e, epochs, ["k"], "frame", "v", 1, 6.0, 4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    got = [(r.k, r.epoch_id, r.sub_epoch_id, r.start_frame, r.end_frame, r.global_id) for r in out.orderBy("k", "global_id").collect()]
    cuts = {0: [5, 26, 59], 1: [50, 68, 89, 122]}
    pairs = [(n, i, *p) for n, c in cuts.items() for i, p in enumerate(zip(c, c[1:]))]
    assert got == [("j", 0, 0, 5, 5, 0)] + [("k", *p, n) for n, p in enumerate([*pairs, (2, 0, 8, 8)])]


def test_samples_without_a_value_hide_nothing(spark, tmp_path):
    """Single nulls and stretches of them longer than a chunk of the query."""
    rng, rows = np.random.default_rng(3), []
    for user in range(12):
        v = rng.integers(0, 60, 150).astype(float).tolist()
        for at, n in ((10, 1), (30, 40), (90, int(rng.integers(1, 30)))):
            v[at : at + n] = [None] * n
        rows += [(user * 1000 + i, user, "view", x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)")).repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("d23_minima", "d23_split"):
        assert oracle.check(spark, con, registry.queries()[name], registry.oracles()[name], str(tmp_path)) > 100
