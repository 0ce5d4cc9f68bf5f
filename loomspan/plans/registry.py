"""Queries over the driver's tables, by name, with the DuckDB SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "c9_phase"
_MODULES = ("algebra", "metadata", "signals", "intervals", "arrays", "models", "statistics", "files", "scalars")
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: events as recordings: the user is the session, the time is in seconds
EVENTS_SQL = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), and the SQL that gives the same rows."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(name)
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql.replace("{events}", EVENTS_SQL)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, event_type, value, t, i``: events with seconds and the place in their user's sequence."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", "user_id", "event_type", "value", (micros / 1e6).alias("t"), i.alias("i"))


def rounded(df: DataFrame, *columns: str, digits: int = 7) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _load() -> None:
    for m in _MODULES:
        import_module(f"loomspan.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
