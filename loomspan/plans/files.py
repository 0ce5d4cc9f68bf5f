"""Sources and sinks: tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging as M
from ..operators.sessions import select_sessions
from ..sources import files as B
from .registry import query, recordings, rounded, table as T


@query("b1_event_log", "SELECT user_id, round(t, 6) AS t, event_type AS event FROM {events}")
def _(s, d):
    path = B.scratch(s, "log")
    recordings(s, d).select("user_id", F.round("t", 6).alias("t"), "event_type").write.csv(path)
    return B.read_event_log(s, path)


@query("b2_daq", "SELECT l_orderkey AS i, l_extendedprice AS t, l_quantity AS x, l_tax AS y, l_discount * 10 > 0.5 AS touch, l_tax * 10 > 0.5 AS wf_sync FROM lineitem")
def _(s, d):
    path = B.scratch(s, "daq")
    T(s, d, "lineitem").selectExpr("l_orderkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount * 10", "l_tax * 10").write.csv(path)
    return B.read_daq(s, path)


@query("b3_params", "SELECT n_nationkey AS id, n_regionkey * 1000 AS sampling_rate, n_name AS name FROM nation")
def _(s, d):
    path = B.scratch(s, "params")
    T(s, d, "nation").selectExpr("n_nationkey `Id`", "n_regionkey `Sampling rate`", "n_name `Name`").repartition(100, "Id").write.option("maxRecordsPerFile", 1).json(path)
    out = B.read_params(s, path, {"Id": "id", "Sampling rate": "sampling_rate", "Name": "name"})
    return out.select(F.col("id").cast("int"), F.col("sampling_rate").cast("int"), "name")


@query("b4_members", "SELECT c_mktsegment AS \"group\", row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS place, c_name AS member FROM customer")
def _(s, d):
    path = B.scratch(s, "members")
    c = T(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("m"))
    c.select(F.concat_ws(",", "c_mktsegment", F.array_join(F.transform("m", lambda x: x["c_name"]), ", "))).write.text(path)
    return B.read_members(s, path)


@query("b5_markers", "SELECT 'animal=' || l_linenumber AS animal, l_quantity AS x, l_extendedprice AS y FROM lineitem")
def _(s, d):
    path = B.scratch(s, "markers")
    li = T(s, d, "lineitem")
    line = F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("\t"), F.col("l_quantity").cast("string"), F.lit("  "), F.col("l_extendedprice").cast("string"), F.lit(" 1"))
    li.select(F.explode(F.array(line, F.lit("; comment 1 2 3"))).alias("value"), F.col("l_linenumber").alias("animal")).write.partitionBy("animal").text(path)
    return B.read_markers(s, path).drop("slice")


@query("b6_discover")
def _(s, d):
    c = T(s, d, "customer")
    first, second = B.scratch(s, "root"), B.scratch(s, "root")
    c.where("c_nationkey < 10").write.partitionBy("c_mktsegment").parquet(first)
    c.where("c_nationkey >= 10").write.partitionBy("c_mktsegment").parquet(second)
    return B.discover(s, [first, second], "*.parquet").select(F.regexp_replace("relative", "/[^/]*$", "").alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


@query("b7_relative_path", "SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN url[13:] ELSE url END AS relative FROM pages")
def _(s, d):
    p = T(s, d, "pages")
    return p.select("page_id", F.when(F.col("url").startswith("https://www."), B.relative_path(F.regexp_replace("url", "^https://www\\.", "/www/"), "/www")).otherwise(F.col("url")).alias("relative"))


@query("b8_lookup", "SELECT c_custkey, name FROM customer JOIN (VALUES ('BUILDING', 'Stroke'), ('MACHINERY', 'Sham')) v(seg, name) ON c_mktsegment = seg")
def _(s, d):
    lookup = s.createDataFrame([("BUILDING", "Stroke"), ("MACHINERY", "Sham")], "c_mktsegment string, name string")
    return T(s, d, "customer").join(F.broadcast(lookup), "c_mktsegment").select("c_custkey", "name")


@query("b9_save_reload", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def _(s, d):
    out = T(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    out.write.parquet(path := B.scratch(s, "dataset"))
    s.read.parquet(path).write.csv(path + "-csv", header=True)
    return s.read.schema(out.schema).csv(path + "-csv", header=True)


@query("b10_export", "SELECT 'orders' AS tab, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', o_orderstatus, count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 2")
def _(s, d):
    o = T(s, d, "orders").withColumnRenamed("o_orderstatus", "status")
    li = T(s, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "status"), "l_orderkey")
    B.export_bundle({"orders": o, "lines": li}, path := B.scratch(s, "bundle"), ["status"])
    back = [s.read.parquet(f"{path}/{n}").groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("tab", F.lit(n)) for n in ("orders", "lines")]
    return back[0].unionByName(back[1]).select("tab", "status", "n")


@query("b11_export_keys", "SELECT o_custkey AS mouse_id, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) IN (-7, -3, -1, 1, 3, 7)")
def _(s, d):
    o = T(s, d, "orders").select(F.col("o_custkey").alias("mouse_id"), "o_orderkey", F.col("o_orderstatus").alias("phase"), F.datediff("o_orderdate", F.lit("1998-01-01").cast("date")).alias("days"))
    return select_sessions(o, days=[-7, -3, -1, 1, 3, 7], phases=["F", "O"]).select("mouse_id", "o_orderkey")


@query("b12_partial_read", "SELECT vec_id, round(avg(v), 7) AS mean FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id < 60 OR vec_id >= (SELECT count(*) FROM embeddings) - 60) GROUP BY 1")
def _(s, d):
    e = T(s, d, "embeddings")
    n = e.agg((F.count(F.lit(1)) / 2).alias("n_frames"))
    part = M.partial_frames(e.crossJoin(F.broadcast(n)), "vec_id", "n_frames", 60)
    return rounded(part.select("vec_id", F.explode("embedding").alias("v")).groupBy("vec_id").agg(F.avg(F.col("v").cast("double")).alias("mean")), "mean")


@query("b13_session_start")
def _(s, d):
    c = T(s, d, "customer")
    c.write.partitionBy("c_mktsegment").parquet(path := B.scratch(s, "recording"))
    files = B.discover(s, [path], "*.parquet").withColumn("c_mktsegment", F.regexp_extract("relative", "c_mktsegment=([^/]*)", 1))
    ends = c.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("duration"))
    return B.session_start(files, ends, "c_mktsegment").select("c_mktsegment", (F.unix_timestamp("modified") - F.unix_timestamp("start")).alias("seconds"))
