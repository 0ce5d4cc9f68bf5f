"""Scalar functions over names, dates, numbers, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.glm import standardise
from .registry import query, rounded, table as T


@query("f1_strings", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 3, '0') AS padded, split_part(replace(p_name, ' ', '_'), '_', 1) AS head, split_part(replace(p_name, ' ', '_'), '_', -1) AS tail, regexp_replace(p_brand, '1$', '') AS short, upper(trim(p_type)) = 'ECONOMY' AS economy FROM part")
def _(s, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return T(s, d, "part").select("p_partkey", X.padded(F.col("p_size"), 3).alias("padded"), X.part(name, 0).alias("head"), X.part(name, -1).alias("tail"), X.without_suffix(F.col("p_brand"), "1").alias("short"), (F.upper(F.trim("p_type")) == "ECONOMY").alias("economy"))


@query("f2_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS text, CAST(o_orderdate AS DATE) AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS rest, make_timestamp(o_orderkey * 86400000000 + 500000) AS at FROM orders")
def _(s, d):
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    at = X.from_epoch(F.col("o_orderkey") * 86400 + F.lit(0.5)).cast("timestamp_ntz")
    return T(s, d, "orders").select("o_orderkey", text.alias("text"), X.parse_day(text, "dd.MM.yyyy").alias("day"), F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("rest"), at.alias("at"))


@query("f3_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(abs(l_discount - 0.05)), 9) AS root, sign(l_discount - 0.05)::DOUBLE AS side, round(degrees(atan2(l_tax, l_discount)), 7) AS angle, floor(l_extendedprice / 300)::BIGINT AS lo, ceil(l_extendedprice / 300)::BIGINT AS hi, greatest(0.02, least(0.08, l_tax)) AS clipped FROM lineitem")
def _(s, d):
    c = F.col
    out = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sqrt(F.abs(c("l_discount") - 0.05)).alias("root"), F.signum(c("l_discount") - 0.05).alias("side"), F.degrees(F.atan2("l_tax", "l_discount")).alias("angle"), F.floor(c("l_extendedprice") / 300).alias("lo"), F.ceil(c("l_extendedprice") / 300).alias("hi"), F.greatest(F.lit(0.02), F.least(F.lit(0.08), c("l_tax"))).alias("clipped"))
    return rounded(rounded(out, "root", digits=9), "angle")


@query("f4_arrays", "SELECT vec_id, round(embedding[63]::DOUBLE, 7) AS rolled, round(embedding[3]::DOUBLE - embedding[2]::DOUBLE, 7) AS diff, round(embedding[6]::DOUBLE, 7) AS taken, list_position(embedding, list_min(embedding)) - 1 AS lowest FROM embeddings")
def _(s, d):
    e = T(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    out = e.select("vec_id", X.roll(F.col("a"), 2)[0].alias("rolled"), X.differences(F.col("a"))[1].alias("diff"), X.take(F.col("a"), F.array(F.lit(1), F.lit(5)))[1].alias("taken"), X.argmin(F.col("a")).alias("lowest"))
    return rounded(out, "rolled", "diff", "taken")


@query("f5_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(s, d):
    return T(s, d, "events").select("event_id", X.options(F.col("props"))["k"].cast("int").alias("k"))


@query("f6_log_grid", "SELECT c_custkey, round(pow(10, -2 + (c_custkey % 50) * 5.0 / 49), 6) AS alpha FROM customer")
def _(s, d):
    return rounded(T(s, d, "customer").select("c_custkey", F.element_at(X.log_spaced(-2, 3, 50), (F.col("c_custkey") % 50 + 1).cast("int")).alias("alpha")), "alpha", digits=6)


@query("h19_standardise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - avg(l_quantity) OVER w) / CASE WHEN stddev_pop(l_quantity) OVER w = 0 THEN 1 ELSE stddev_pop(l_quantity) OVER w END, 7) AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def _(s, d):
    return rounded(standardise(T(s, d, "lineitem"), ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_quantity")
