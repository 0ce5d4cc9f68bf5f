"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is made for a session whose executors are in the driver's process, and
    stored in the setting. A cluster has no folder that could be guessed, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "local") + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    for scope in _scopes:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_of(df: DataFrame) -> str:
    """The folder of a table made by :func:`written`."""
    return df.inputFiles()[0].rpartition("/")[0]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written` once nothing needs it."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written in the block are deleted at its end, but for those taken out of the list that it yields."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        for folder in scope:
            _delete(spark, folder)


def join_heavy(big: DataFrame, small: DataFrame, key: str, share: int = 2_000) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row for each ``key``, whatever rows of ``big`` hold one key.

    A key of over 100 rows and more than 1 / ``share`` of all rows with such keys is heavy. There are fewer than ``share`` such keys for any table, so their rows of
    ``small`` are broadcast; the other keys are joined by a shuffle, in which no key has more than that share. ``big`` is read twice.
    """
    counts = written(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 100"), "key-counts")
    least = (counts.agg(F.sum("_n")).first()[0] or 0) / share
    heavy = counts.where((F.col("_n") > least) & (F.col("_n") > 100)).select(key)
    if heavy.isEmpty():
        return big.join(small, key)
    heavy = F.broadcast(written(heavy.repartition(1), "heavy-keys"))
    near = F.broadcast(written(small.join(heavy, key, "left_semi").repartition(1), "heavy-rows"))
    return big.join(near, key).unionByName(big.join(heavy, key, "left_anti").join(small, key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def conf_set(spark: SparkSession, **values: str):
    """Set session options (``__`` stands for a dot) for actions inside the block."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Component of every vertex of an undirected graph, as ``(node, root)``.

    Randomised contraction: each round every vertex hooks to the neighbour (or itself) of the smallest salted
    hash, edges are rewritten to the chosen vertices, and the expected number of vertices falls by a constant
    factor, so a path of n vertices takes O(log n) rounds. Every round is two equi-joins and two hash
    aggregations, written to the shared folder; nothing is collected but an edge count.
    ``root`` is an arbitrary vertex of the component. Null ends and loops are ignored; an empty input gives no rows.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    live = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    salt = 0
    while not live.isEmpty():
        salt += 1
        rank = lambda c, s=salt: F.struct(F.xxhash64(F.lit(s), c).alias("h"), F.col(c).alias("v"))
        hook = live.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["v"].alias("to"))
        hook = written(hook, "cc-map")
        maps.append(hook)
        one = live.join(hook, "a").select(F.col("to").alias("x"), "b")
        two = one.join(hook.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        following = written(two.where("a <> b").distinct(), "cc-edges")
        drop_written(live)
        live = following
    if not maps:
        return ends.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = maps[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for earlier in reversed(maps[:-1]):
        later = out.withColumnRenamed("node", "to").withColumnRenamed("root", "later")
        out = earlier.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("later", "to").alias("root"))
    return written(out, "cc-out")


def whole_shards(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches sorted by shard, their first ``keys`` columns, cut anew so that no shard is in two tables."""
    held: list[pa.RecordBatch] = []
    of = lambda batch, k: tuple(batch.column(c)[k].as_py() for c in range(keys))
    for batch in batches:
        if not batch.num_rows:
            continue
        last = of(batch, batch.num_rows - 1)
        same = np.all([batch.column(c).to_numpy() == last[c] for c in range(keys)], axis=0)
        cut = int(np.argmax(same))
        if cut or (held and of(held[-1], held[-1].num_rows - 1) != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
