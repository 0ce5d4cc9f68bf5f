"""Relational algebra over keyed tables: restriction, projection, joins, grouped aggregation and incremental computation.

A condition is SQL text, a mapping (all equalities hold; names the table lacks are ignored), a list of conditions (any holds)
or another table (its common columns match a row).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def _column(df: DataFrame, cond) -> Column:
    if isinstance(cond, Column):
        return cond
    if isinstance(cond, str):
        return F.expr(cond)
    if isinstance(cond, Mapping):
        tests = [F.col(k).eqNullSafe(F.lit(v)) for k, v in cond.items() if k in df.columns]
        return reduce(lambda x, y: x & y, tests, F.lit(True))
    return reduce(lambda x, y: x | y, [_column(df, c) for c in cond], F.lit(False))


def restrict(df: DataFrame, *conds) -> DataFrame:
    """Rows that meet every condition; a table as condition is a semi-join on the common columns."""
    for cond in conds:
        if isinstance(cond, DataFrame):
            on = common(df, cond)
            df = df.join(cond.select(on).distinct(), on, "left_semi") if on else df.where(F.lit(not cond.isEmpty()))
        else:
            df = df.where(_column(df, cond))
    return df


def anti(df: DataFrame, *conds) -> DataFrame:
    """Rows that do not meet the condition, or have no matching row in a table."""
    for cond in conds:
        if isinstance(cond, DataFrame):
            on = common(df, cond)
            df = df.join(cond.select(on), on, "left_anti") if on else df.where(F.lit(cond.isEmpty()))
        else:
            df = df.where(~F.coalesce(_column(df, cond), F.lit(False)))
    return df


def natural_join(a: DataFrame, *others: DataFrame, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Join on all common columns, one table after another.

    Tables without a common column give a product, whose smaller side is broadcast; it is an error if both have more than ``most`` rows.
    """
    for b in others:
        on = common(a, b)
        if on:
            a = a.join(b, on, how)
        elif b.limit(most + 1).count() <= most:
            a = a.crossJoin(F.broadcast(b))
        elif a.limit(most + 1).count() <= most:
            a = F.broadcast(a).crossJoin(b)
        else:
            raise ValueError(f"no common column, and both sides have more than {most} rows")
    return a


def proj(df: DataFrame, *cols: str, pk: list[str], **new: str) -> DataFrame:
    """The key, the named columns, and ``new_name="column"`` or ``new_name="expression"``."""
    plain = {v: k for k, v in new.items() if v in df.columns}
    keys = [F.col(c).alias(plain.get(c, c)) for c in pk]
    rest = [F.expr(v).alias(k) for k, v in new.items() if v not in pk]
    return df.select(*keys, *[c for c in cols if c not in pk], *rest)


def aggr(g: DataFrame, t: DataFrame, pk: list[str], keep_all: bool = False, **exprs: str) -> DataFrame:
    """Rows of ``g`` with aggregates over the matching rows of ``t``; rows without any vanish unless ``keep_all``."""
    if not exprs:
        return restrict(g, t.select([c for c in pk if c in t.columns]))
    summed = t.groupBy(pk).agg(*[F.expr(v).alias(k) for k, v in exprs.items()])
    return g.join(summed, pk, "left" if keep_all else "inner")


def fetch(df: DataFrame, *cols: str, order_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Columns in an order; ``order_by`` takes "name" and "name DESC"."""
    if order_by:
        df = df.orderBy(*[F.col(x[:-5].strip()).desc() if x.upper().endswith(" DESC") else F.col(x) for x in order_by])
    df = df.limit(limit) if limit is not None else df
    return df.select(*cols) if cols else df


def keys(df: DataFrame, pk: list[str]) -> DataFrame:
    return df.select(pk).distinct()


def violations_of_single(df: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that have more than one row: what a fetch of exactly one row refuses."""
    return df.groupBy(pk).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def cardinality(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def todo(key_source: DataFrame, done: DataFrame, pk: list[str], order: str | None = None, limit: int | None = None) -> DataFrame:
    """Keys still to be computed; ``order="random"`` shuffles them by hash."""
    left = key_source.join(done.select(pk), pk, "left_anti")
    if order == "random":
        left = left.orderBy(F.xxhash64(*pk))
    return left.limit(limit) if limit is not None else left


def populate(key_source: DataFrame, done: DataFrame, pk: list[str], make) -> DataFrame:
    """``done`` with the rows that ``make`` (DataFrame to DataFrame) gives for all missing keys at once."""
    return done.unionByName(make(todo(key_source, done, pk)))


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_new(table: DataFrame, rows: DataFrame, pk: list[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose key it lacks; of rows of one key, any one."""
    return table.unionByName(rows.dropDuplicates(pk).join(table.select(pk), pk, "left_anti"))


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Rows numbered from 0 in an order over the whole table, without bringing them into one task.

    Rows are range-partitioned and numbered inside their partition, written once, and shifted by the sizes of the
    partitions before: one row per partition.
    """
    from ..sources.files import scratch

    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    rows.withColumn("_l", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    return rows.join(shift, "_p").withColumn(out, F.col("_s") + F.col("_l")).drop("_p", "_l", "_s")


def next_counter(table: DataFrame, rows: DataFrame, order: list, counter: str, group: list[str] | None = None) -> DataFrame:
    """``rows`` numbered on from the largest counter of their group in ``table``, or from 0."""
    if not group:
        most = table.agg(F.max(counter).alias("_most"))  # one row
        joined = numbered(rows, order, "_n").crossJoin(F.broadcast(most))
    else:
        most = table.groupBy(group).agg(F.max(counter).alias("_most"))
        joined = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).join(most, group, "left")
    return joined.withColumn(counter, F.coalesce("_most", F.lit(-1)) + 1 + F.col("_n")).drop("_most", "_n")


def check_constraints(df: DataFrame, pk: list[str], not_null: list[str] = (), enums: Mapping[str, list] | None = None, parent: DataFrame | None = None) -> DataFrame:
    """``pk..., rule`` of each broken rule: nulls, values outside an enumeration, keys without a parent row."""
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in not_null]
    tests += [F.when(~F.col(c).isin(list(v)), F.lit(f"{c} out of range")) for c, v in (enums or {}).items()]
    out = df.select(*pk, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("rule")) if tests else None
    if parent is not None:
        lost = anti(df, parent).select(*pk, F.lit("no parent").alias("rule"))
        out = lost if out is None else out.unionByName(lost)
    return out


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot_counts(df: DataFrame, ids: list[str], column: str, levels: list[str], suffix: str = "") -> DataFrame:
    """Counts per level as columns, absent cells as 0."""
    out = df.groupBy(ids).pivot(column, levels).count().na.fill(0, levels)
    return out.withColumnsRenamed({x: f"{x}{suffix}" for x in levels})


def to_matrix(df: DataFrame, key: list[str], label: str, value: str, labels: list[str]) -> DataFrame:
    """One column per label, in label order."""
    return df.where(F.col(label).isin(labels)).groupBy(key).pivot(label, sorted(labels)).agg(F.first(value))


def ordered_level(column: str, levels: list[str]) -> Column:
    """Rank of a categorical value by explicit level order, from 0; null for other values."""
    at = F.array_position(F.lit(levels), F.col(column))
    return F.when(at > 0, at - 1)


def aligned(a: DataFrame, b: DataFrame, on: list[str], value: str, op: str, out: str) -> DataFrame:
    """``a`` with ``value op b.value`` on a shared, possibly shorter key."""
    return a.join(b.select(*on, F.col(value).alias("_other")), on).withColumn(out, F.expr(f"{value} {op} _other")).drop("_other")
