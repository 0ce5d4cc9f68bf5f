"""Incremental computation key by key: a key that fails leaves the rows of the others alone and is tried again by the next run."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import materialised
from .algebra import todo


class PopulateError(RuntimeError):
    """Some keys failed; the rows of the others are in the table."""


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table in a folder, empty where the folder does not exist yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def populate_each(
    key_source: DataFrame, inputs: DataFrame, pk: list[str], make: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: str, target: str, errors: str, suppress_errors: bool = False, order: str | None = None, limit: int | None = None, keys_of_a_batch: int = 1_000, rows_of_a_batch: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """Add to the table in the folder ``target`` the rows that ``make`` gives for each key of ``key_source`` that it lacks; returns that table and the one in ``errors``.

    ``make`` gets a key as a dict and the key's rows of ``inputs`` (none if there are none), one call for each key of a batch, and gives rows of ``schema``, without the key's columns, which are added. What it raises becomes a row of
    ``errors``: the key, the number of the attempt, the error's kind and message. All keys are tried; without ``suppress_errors`` failures are then raised as ``PopulateError``, when the rows of the others are written.
    A key without rows in ``target``, because it failed or gave none, is missing again in the next run. ``order="random"`` shuffles the keys, which matters with ``limit``, the most keys of a run. Keys are distinct and not null.
    """
    spark, types = key_source.sparkSession, dict(key_source.dtypes)
    keys_sql = ", ".join(f"`{k}` {types[k]}" for k in pk)
    error_sql = f"{keys_sql}, attempt int, kind string, message string"
    full_sql = f"{keys_sql}, {schema}"
    columns = [f.name for f in spark.createDataFrame([], full_sql).schema.fields]
    left = materialised(todo(key_source.select(pk).dropna().distinct(), _table(spark, target, full_sql), pk, order, limit), "keys")  # chosen once

    values = [c for c in columns if c not in pk]

    def run(keys: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        places = rows.groupby(pk if len(pk) > 1 else pk[0], sort=False).indices
        rows = rows.take([i for at in places.values() for i in at])  # each key's rows together, in the order they came in
        ends = dict(zip(places, accumulate(len(at) for at in places.values())))
        none, made, owner, failed = rows.iloc[:0], [], [], []
        for i, key in enumerate(zip(*[keys[k] for k in pk])):
            name = key if len(pk) > 1 else key[0]
            own = rows.iloc[ends[name] - len(places[name]) : ends[name]].copy(deep=False) if name in ends else none.copy()
            own.index = pd.RangeIndex(len(own))
            try:
                own = make(dict(zip(pk, key)), own)
                own = own if list(own.columns) == values else own[values]
                if len(own):
                    made.append(own)
                    owner += [i] * len(own)
            except Exception as e:  # whatever a user's function raises belongs to its key
                failed.append((i, type(e).__name__, str(e)[:1000]))
        if len({tuple(own.dtypes) for own in made}) == 1:
            parts = pd.concat(made, ignore_index=True)
        else:  # columns of which keys give different types stay as given, so that numbers are not made floats
            parts = {c: pd.concat([own[c].astype(object) for own in made], ignore_index=True) if made else pd.Series([], dtype=object) for c in values}
        out = pd.DataFrame({**{k: keys[k].iloc[owner].reset_index(drop=True) for k in pk}, **dict(parts)}).assign(_kind=None, _message=None)
        if failed:
            bad = keys[pk].iloc[[i for i, _, _ in failed]].reset_index(drop=True)
            bad = bad.assign(_kind=[k for _, k, _ in failed], _message=[m for _, _, m in failed])
            out = pd.concat([out.astype(object), bad.reindex(columns=out.columns).astype(object).where(lambda x: x.notna(), None)], ignore_index=True)
        return out[[*columns, "_kind", "_message"]]

    wanted = inputs.join(left, pk, "left_semi")
    # a call of the task holds a batch: a group for each key costs more than most keys' work
    batches = max(1, -(-left.count() // keys_of_a_batch), -(-inputs.count() // rows_of_a_batch))
    batch = F.pmod(F.xxhash64(*pk), F.lit(batches)).alias("_batch")
    made = left.select("*", batch).groupBy("_batch").cogroup(wanted.select("*", batch).groupBy("_batch")).applyInPandas(lambda k, r: run(k, r.drop(columns="_batch")), f"{full_sql}, _kind string, _message string")
    made = materialised(made, "populated")  # each key is computed once
    failed = made.where(F.col("_kind").isNotNull())
    before = _table(spark, errors, error_sql).groupBy(pk).agg(F.max("attempt").alias("_last"))
    failed = failed.join(before, pk, "left").select(*pk, (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("attempt"), F.col("_kind").alias("kind"), F.col("_message").alias("message"))
    failed = materialised(failed, "failed")
    made.where(F.col("_kind").isNull()).select(columns).write.mode("append").parquet(target)
    failed.write.mode("append").parquet(errors)
    if not suppress_errors and (some := failed.limit(3).collect()):
        raise PopulateError(f"{failed.count()} keys failed, such as " + "; ".join(f"{[r[k] for k in pk]}: {r.kind}: {r.message}" for r in some))
    return _table(spark, target, full_sql), _table(spark, errors, error_sql)
