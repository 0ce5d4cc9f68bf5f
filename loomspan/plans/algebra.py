"""Relational algebra over the order tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import algebra as A
from ..operators.incremental import populate_each
from ..sources.files import scratch
from .registry import query, rounded, table as T

PK = ["c_custkey"]


def _keyed(s, d):
    """Customers, orders and nations with shared names for shared keys."""
    c = T(s, d, "customer").withColumnsRenamed({"c_custkey": "custkey", "c_nationkey": "nationkey"})
    o = T(s, d, "orders").withColumnRenamed("o_custkey", "custkey")
    n = T(s, d, "nation").withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    r = T(s, d, "region").withColumnRenamed("r_regionkey", "regionkey")
    return c, o, n, r


@query("a1_restrict_text", "SELECT c_custkey, c_name FROM customer WHERE (c_acctbal >= 5000 OR c_acctbal < 0) AND c_nationkey <> 3")
def _(s, d):
    return A.restrict(T(s, d, "customer"), "c_acctbal >= 5000 OR c_acctbal < 0", "c_nationkey <> 3").select("c_custkey", "c_name")


@query("a2_restrict_mapping", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5")
def _(s, d):
    return A.restrict(T(s, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 5, "session_num": 1}).select("c_custkey")


@query("a3_restrict_any", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 1 OR c_acctbal > 9000")
def _(s, d):
    return A.restrict(T(s, d, "customer"), [{"c_mktsegment": "BUILDING"}, "c_nationkey = 1", "c_acctbal > 9000"]).select("c_custkey", "c_mktsegment")


@query("a4_restrict_table", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    return A.restrict(c, A.restrict(o, "o_orderstatus = 'F'").select("custkey")).select(F.col("custkey").alias("c_custkey"))


@query("a5_anti_restrict", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    return A.anti(c, A.restrict(o, "o_totalprice > 300000").select("custkey")).select(F.col("custkey").alias("c_custkey"))


@query("a6_like", r"SELECT p_partkey, p_name FROM part WHERE p_brand LIKE 'Brand#1_' AND p_name LIKE '%ring'")
def _(s, d):
    p = T(s, d, "part")
    return A.restrict(p, F.col("p_brand").like("Brand#1_"), F.col("p_name").like("%ring")).select("p_partkey", "p_name")


@query("a7_not_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND NOT (o_orderpriority = '5-LOW')")
def _(s, d):
    return A.anti(A.restrict(T(s, d, "orders"), "o_orderstatus <> 'P'"), "o_orderpriority = '5-LOW'").select("o_orderkey")


@query("a8_natural_join", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    c, o, n, r = _keyed(s, d)
    return A.natural_join(o, c, n, r).select("o_orderkey", "c_name", "n_name", "r_name")


@query("a9_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def _(s, d):
    return A.natural_join(T(s, d, "nation").select("n_name"), T(s, d, "region").select("r_name"))


@query("a10_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(s, d):
    return A.proj(T(s, d, "customer"), "c_name", "c_mktsegment", pk=PK)


@query("a11_rename", "SELECT c_custkey, c_mktsegment AS stroke_group FROM customer")
def _(s, d):
    return A.proj(T(s, d, "customer"), pk=PK, stroke_group="c_mktsegment")


@query("a12_computed", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_extendedprice * (1 - l_discount), 7) AS net FROM lineitem")
def _(s, d):
    return rounded(A.proj(T(s, d, "lineitem"), "l_quantity", pk=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], net="l_extendedprice * (1 - l_discount)"), "net")


@query("a13_aggr", "SELECT custkey, c_name, first_day, n FROM (SELECT o_custkey AS custkey, min(o_orderdate) AS first_day, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = custkey")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    return A.aggr(c, o, ["custkey"], first_day="min(o_orderdate)", n="count(1)").select("custkey", "c_name", "first_day", "n")


@query("a14_exists", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    return A.aggr(c, A.restrict(o, "o_orderpriority = '1-URGENT'"), ["custkey"]).select("custkey")


@query("a15_fetch_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(s, d):
    return A.fetch(T(s, d, "orders"), "o_orderkey", "o_totalprice", order_by=["o_totalprice DESC", "o_orderkey"], limit=25)


@query("a16_single", "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return A.violations_of_single(T(s, d, "orders"), ["o_custkey"])


@query("a17_frame", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(s, d):
    return A.keys(T(s, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("a18_cardinality", "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05")
def _(s, d):
    return A.cardinality(A.restrict(T(s, d, "lineitem"), "l_discount > 0.05"))


@query("a19_membership", "SELECT c_custkey AS custkey, o.n IS NOT NULL AS present, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1) o ON o_custkey = c_custkey")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    out = A.aggr(c, A.restrict(o, "o_totalprice > 250000"), ["custkey"], keep_all=True, n="count(1)")
    return out.select("custkey", F.col("n").isNotNull().alias("present"), "n")


@query("a20_populate", "SELECT o_custkey AS custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderstatus) < 'P' AS had FROM orders GROUP BY 1")
def _(s, d):
    _, o, _, _ = _keyed(s, d)
    make = lambda ks, had: A.aggr(ks, o, ["custkey"], n="count(1)", total="round(sum(o_totalprice), 2)", had="min(o_orderstatus) < 'P'")
    every = A.keys(o, ["custkey"])
    done = make(every.where("custkey % 3 = 0"), True)
    return A.populate(every, done, ["custkey"], lambda ks: make(ks, False))


@query("a20_populate_each", "SELECT o_custkey AS custkey, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, o_custkey % 5 = 0 AS again FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1")
def _(s, d):
    # the first run fails for every fifth and every seventh customer, the second for the latter alone
    _, o, _, _ = _keyed(s, d)
    path = scratch(s, "customers")

    def make(bad, again):
        def run(key, rows):
            if any(key["custkey"] % b == 0 for b in bad):
                raise ValueError("refused")
            return pd.DataFrame({"n": [len(rows)], "total": [rows["o_totalprice"].sum()], "again": [again]})

        return run

    for bad, again in (((5, 7), False), ((7,), True)):
        out, _ = populate_each(A.keys(o, ["custkey"]), o.select("custkey", "o_totalprice"), ["custkey"], make(bad, again), "n long, total double, again boolean", f"{path}/rows", f"{path}/errors", suppress_errors=True)
    return out.withColumn("total", F.round("total", 2))


@query("a21_key_source", "SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(s, d):
    _, o, _, _ = _keyed(s, d)
    return A.todo(A.keys(A.restrict(o, "o_orderstatus = 'F'"), ["custkey"]), A.restrict(o, "o_totalprice > 400000"), ["custkey"])


@query("a22_first_per_group", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(s, d):
    return A.first_per_group(T(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("a23_insert_new", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(s, d):
    o = T(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return A.insert_new(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 <> 0 OR o_orderkey % 6 = 3").unionByName(o.where("o_orderkey % 5 = 0")), ["o_orderkey"])


@query("a24_derived_rows", "SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'weight', o_orderkey, o_totalprice / 1000 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <> 0")
def _(s, d):
    o = T(s, d, "orders").where("o_orderstatus = 'P'")
    main = o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return A.union_all(main, o.where("o_totalprice <> 0").select(F.lit("weight").alias("kind"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("v")))


@query("a25_next_counter", "SELECT o_orderkey, (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) IS NULL AS fresh, coalesce((SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey), -1) + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS counter FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    sup = T(s, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_suppkey").alias("counter"))
    rows = A.next_counter(sup, A.natural_join(o, c.select("custkey", "nationkey")), ["o_orderdate", "o_orderkey"], "counter", ["nationkey"])
    return rows.join(A.keys(sup, ["nationkey"]).withColumn("_in", F.lit(1)), "nationkey", "left").select("o_orderkey", F.col("_in").isNull().alias("fresh"), "counter")


@query("a26_sequence", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS care_num FROM orders")
def _(s, d):
    o = T(s, d, "orders")
    none = o.where("false").select("o_custkey", F.lit(0).alias("care_num"))
    return A.next_counter(none, o, ["o_orderdate", "o_orderkey"], "care_num", ["o_custkey"]).select("o_custkey", "o_orderkey", "care_num")


@query("a27_constraints", "SELECT o_orderkey, 'o_orderstatus out of range' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'no parent' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    return A.check_constraints(o, ["o_orderkey"], not_null=["o_orderstatus", "custkey"], enums={"o_orderstatus": ["F", "O"]}, parent=c.where("c_acctbal > 0").select("custkey"))


@query("a28_union", "SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def _(s, d):
    return A.union_all(T(s, d, "customer").selectExpr("c_nationkey nationkey", "c_acctbal acctbal", "'customer' kind"), T(s, d, "supplier").selectExpr("s_nationkey nationkey", "s_acctbal acctbal", "'supplier' kind"))


@query("a29_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS day FROM lineitem")
def _(s, d):
    return A.keys(T(s, d, "lineitem").withColumn("day", F.to_date("l_shipdate")), ["l_returnflag", "l_linestatus", "day"])


@query("a30_left_join", "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def _(s, d):
    _, _, n, _ = _keyed(s, d)
    sup = T(s, d, "supplier").withColumnRenamed("s_nationkey", "nationkey")
    return A.natural_join(n, sup, how="left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("a31_columns", "SELECT c_custkey AS mouse_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Stroke' WHEN 'MACHINERY' THEN 'Sham' ELSE c_mktsegment END AS grp FROM customer")
def _(s, d):
    return T(s, d, "customer").drop("c_name", "c_acctbal", "c_nationkey").withColumnsRenamed({"c_custkey": "mouse_id", "c_mktsegment": "grp"}).replace({"BUILDING": "Stroke", "MACHINERY": "Sham"}, subset=["grp"])


@query("a32_filter_fill", "SELECT c_custkey, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey WHERE c_acctbal > 100")
def _(s, d):
    c, o, _, _ = _keyed(s, d)
    return A.aggr(c.where("c_acctbal > 100"), o.where("o_orderstatus = 'P'"), ["custkey"], keep_all=True, n="count(1)").na.fill(0, ["n"]).select(F.col("custkey").alias("c_custkey"), "n")


_UNPIVOT = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, u.measure, u.v FROM lineitem, LATERAL (VALUES ('l_discount', l_discount), ('l_quantity', l_quantity), ('l_tax', l_tax)) u(measure, v)"


@query("a33_unpivot", _UNPIVOT)
def _(s, d):
    return A.unpivot(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "v")


@query("a34_pivot_counts", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A_n, count(*) FILTER (l_returnflag = 'N') AS N_n, count(*) FILTER (l_returnflag = 'R') AS R_n FROM lineitem GROUP BY 1")
def _(s, d):
    return A.pivot_counts(T(s, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "_n")


@query("a35_melt_two", "SELECT c_custkey, 'acct' AS state, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey FROM customer")
def _(s, d):
    c = T(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acct"), F.col("c_nationkey").cast("double").alias("nation"))
    return A.unpivot(c, ["c_custkey"], ["acct", "nation"], "state", "v")


@query("a36_levels", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'HOUSEHOLD' THEN 2 END AS level FROM customer")
def _(s, d):
    return T(s, d, "customer").select("c_custkey", A.ordered_level("c_mktsegment", ["MACHINERY", "BUILDING", "HOUSEHOLD"]).alias("level"))


@query("a37_matrix", "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM (SELECT user_id, event_type, max(value) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) GROUP BY user_id")
def _(s, d):
    e = T(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return A.to_matrix(e, ["user_id"], "event_type", "value", ["view", "click"])


@query("a38_aggregates", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, median(l_extendedprice) AS med, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS first FROM lineitem GROUP BY 1")
def _(s, d):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return T(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"), F.median("l_extendedprice").alias("med"), F.min_by("l_suppkey", order).alias("first"))


@query("a39_aligned", "SELECT o_orderkey, round(o_totalprice - m, 6) AS rest FROM orders JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = k")
def _(s, d):
    o = T(s, d, "orders")
    mean = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return rounded(A.aligned(o.withColumnRenamed("o_totalprice", "m"), mean, ["o_custkey"], "m", "-", "rest").select("o_orderkey", "rest"), "rest", digits=6)
