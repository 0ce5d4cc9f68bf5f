"""Readers and writers of the recordings' files: event logs, sensor matrices, parameters, ragged lists, markers, export bundles."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or where a local session leaves that unset, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "local") + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of ``scratch`` and read from there, so that what follows does not compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_event_log(spark: SparkSession, path: str, keys: str = "user_id long") -> DataFrame:
    """CSV without header: key columns, time, event name."""
    return spark.read.schema(f"{keys}, t double, event string").csv(path)


def read_daq(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    """CSV without header: ``i, t, x, y, touch, wf_sync``; the last two as flags."""
    rows = spark.read.schema("i long, t double, x double, y double, touch double, wf_sync double").csv(path)
    return rows.withColumns({"touch": F.col("touch") > threshold, "wf_sync": F.col("wf_sync") > threshold})


def read_params(spark: SparkSession, path: str, renames: dict[str, str], khz: str = "sampling_rate") -> DataFrame:
    """JSON objects to one row each, with plain names; the sampling rate from kHz to Hz."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select([F.col(f"`{old}`").alias(new) for old, new in renames.items()]).withColumn(khz, F.col(khz) * 1000)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``group, place, member`` of lines ``group,member,member,...`` of any length; blanks are left out."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).alias("group"), F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("place", "member"))
    return rows.withColumn("member", F.trim("member")).where("member <> ''")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """``animal, slice, x, y`` of white-space separated lines; the folder is the animal, the file the slice; ``;`` starts a comment."""
    rows = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    part = F.split(F.trim("value"), r"\s+")
    rows = rows.where(~F.trim("value").startswith(";") & (F.size(part) >= 3))
    folder = F.split("file", "/")
    return rows.select(F.element_at(folder, -2).alias("animal"), F.element_at(folder, -1).alias("slice"), part[1].cast("double").alias("x"), part[2].cast("double").alias("y")).where("x is not null and y is not null")


def relative_path(path: Column, root: str) -> Column:
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)


def discover(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """``relative, path, modified``: files by name pattern under several roots; of equal relative paths the first root's.

    Only the files' metadata is read. Raises if no root has such a file.
    """
    found = []
    for n, root in enumerate(roots):
        rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
        plain = F.regexp_replace("path", "^file:/+", "/")
        found.append(rows.select(relative_path(plain, root.removeprefix("file://")).alias("relative"), "path", F.col("modificationTime").alias("modified"), F.lit(n).alias("_n")))
    every = reduce(DataFrame.unionByName, found)
    out = every.withColumn("_k", F.row_number().over(Window.partitionBy("relative").orderBy("_n"))).where("_k = 1").drop("_k", "_n")
    if out.isEmpty():
        raise FileNotFoundError(f"{pattern} in {roots}")
    return out


def session_start(files: DataFrame, durations: DataFrame, on: str) -> DataFrame:
    """The files' modification time less the session's duration in seconds."""
    return files.join(durations, on).withColumn("start", F.col("modified") - F.make_dt_interval(secs=F.col("duration").cast("decimal(18,6)")))


def export_bundle(tables: dict[str, DataFrame], path: str, by: list[str], rows: int = 500_000) -> None:
    """One partitioned dataset per table, a folder per session; sessions of more than some ``rows`` rows are dealt over tasks, a file each."""
    for name, df in tables.items():
        spread = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)  # at most one for every ``rows`` rows
        sizes = sizes.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], F.ceil(F.col("_n") / rows).alias("_files"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)])
        parts = df.join(F.broadcast(sizes), same, "left").withColumn("_file", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_files")), F.lit(0)))
        parts = parts.repartition(_parts(df, rows), *by, "_file")
        parts.select(df.columns).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def _parts(df: DataFrame, rows: int) -> int:
    """Into how many parts to deal a table so that a part has some ``rows`` rows, as many as the session shuffles to at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
