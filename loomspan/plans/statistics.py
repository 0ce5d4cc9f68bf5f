"""Baselines, correlations and group comparisons over orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mixed as X
from ..operators import stats as H
from .registry import query, recordings, rounded, table as T


def _li(s, d):
    return T(s, d, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1998-06-01").cast("date")))


def _student(t: str, dof: str) -> str:
    """SQL of the two-sided p-value: Simpson's rule over the angle whose tangent is t over the root of the degrees of freedom."""
    angle = f"(atan(abs({t}) / sqrt({dof})) / 4000)"
    area = f"list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({angle} * k), {dof} - 1)))"
    return f"greatest(0, 1 - 2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * {area} * {angle} / 3)"


@query("h1_baseline_median", "WITH b AS (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem WHERE l_shipdate < DATE '1998-06-01' GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l.l_suppkey, l_quantity - m AS l_quantity FROM lineitem l JOIN b ON b.l_suppkey = l.l_suppkey")
def _(s, d):
    return H.baseline(_li(s, d), ["l_suppkey"], "l_quantity", F.col("day") < 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("h2_baseline_mean", "WITH b AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem WHERE l_shipdate < DATE '1998-06-01' GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l.l_suppkey, round(l_quantity - m, 7) AS l_quantity FROM lineitem l JOIN b ON b.l_suppkey = l.l_suppkey")
def _(s, d):
    return rounded(H.baseline(_li(s, d), ["l_suppkey"], "l_quantity", F.col("day") < 0, how="mean").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_quantity")


_PIX = "SELECT label, p - 1 AS pixel, embedding[p]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS p)"


@query("h3_map_mean", f"SELECT label, pixel, round(avg(v), 7) AS mean FROM ({_PIX}) GROUP BY 1, 2")
def _(s, d):
    e = T(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(H.map_average(e, ["label"], "embedding"), "mean")


@query("h3_map_median", f"SELECT label, pixel, round(median(v), 7) AS median FROM ({_PIX}) GROUP BY 1, 2")
def _(s, d):
    e = T(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(H.map_average(e, ["label"], "embedding", how="median"), "median")


@query("h4_nested_mean", "SELECT o_orderstatus, round(avg(m), 5) AS o_totalprice FROM (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return rounded(H.nested_mean(T(s, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderstatus"], "o_totalprice"), "o_totalprice", digits=5)


@query("h5_mean_sem", "SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice), 5) AS mean, round(stddev_pop(l_extendedprice) / sqrt(count(l_extendedprice)), 5) AS sem, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return rounded(H.mean_sem(T(s, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice"), "mean", "sem", digits=5)


@query("h6_quartiles", "SELECT l_suppkey, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 5) AS q25, round(median(l_extendedprice), 5) AS median, round(quantile_cont(l_extendedprice, 0.75), 5) AS q75 FROM lineitem GROUP BY 1")
def _(s, d):
    return rounded(H.quartiles(T(s, d, "lineitem"), ["l_suppkey"], "l_extendedprice"), "q25", "median", "q75", digits=5)


@query(
    "h7_t_test",
    """WITH m AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1)
SELECT round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round(sqrt(a.v / a.n), 6) AS sem_a, round(sqrt(b.v / b.n), 6) AS sem_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t, a.n + b.n - 2 AS dof, round({P}, 7) AS p_value FROM m a, m b WHERE a.g = 'BUILDING' AND b.g = 'MACHINERY'""".replace("{P}", _student("(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))", "(a.n + b.n - 2)")),
)
def _(s, d):
    return rounded(H.t_test(T(s, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").withColumn("p_value", F.round("p_value", 7)), "mean_a", "mean_b", "sem_a", "sem_b", "t", digits=6)


@query("h8_spearman", "WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_suppkey, round(rho, 7) AS rho, n, round(" + _student("rho * sqrt((n - 2) / (1 - rho * rho))", "(n - 2)") + ", 7) AS p_value FROM (SELECT l_suppkey, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY 1)")
def _(s, d):
    return rounded(H.spearman(T(s, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), "rho", "p_value")


@query("h9_pearson", "SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 7) AS r FROM lineitem GROUP BY 1")
def _(s, d):
    return rounded(T(s, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("r")), "r")


@query("h10_contrast", "SELECT l_suppkey, round(avg(l_extendedprice) FILTER (l_returnflag = 'A') - avg(l_extendedprice) FILTER (l_returnflag = 'R'), 5) AS difference FROM lineitem GROUP BY 1")
def _(s, d):
    return rounded(H.contrast(T(s, d, "lineitem"), ["l_suppkey"], "l_returnflag", "l_extendedprice", "A", "R"), "difference", digits=5)


_P = "SELECT o_orderkey, o_orderpriority AS g, (o_orderkey * 7919 % 1000003 + 1) / 2000008.0::DOUBLE AS p FROM orders"


def _p(s, d):
    return T(s, d, "orders").selectExpr("o_orderkey", "o_orderpriority g", "(o_orderkey * 7919 % 1000003 + 1) / 2000008.0D p")


@query("h11_bh", f"WITH p AS (SELECT *, count(*) OVER (PARTITION BY g) AS m, row_number() OVER (PARTITION BY g ORDER BY p) AS r FROM ({_P})) SELECT o_orderkey, round(least(1.0, min(p * m / r) OVER (PARTITION BY g ORDER BY r DESC)), 9) AS p_adjusted FROM p")
def _(s, d):
    return rounded(H.bh_adjust(_p(s, d), "p", ["g"]).select("o_orderkey", "p_adjusted"), "p_adjusted", digits=9)


@query("h11_bh_all", f"WITH p AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM ({_P})) SELECT o_orderkey, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC)), 9) AS p_adjusted FROM p")
def _(s, d):
    return rounded(H.bh_adjust(_p(s, d), "p").select("o_orderkey", "p_adjusted"), "p_adjusted", digits=9)


def _units(s, d):
    return T(s, d, "lineitem").select("l_linenumber", "l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("y"))


@query("h12_mixed_contrasts")
def _(s, d):
    return X.mixed_contrasts(_units(s, d), ["l_linenumber"], "y", "l_returnflag", "l_linestatus", "l_suppkey")


@query("h12_nested_contrasts")
def _(s, d):
    return X.mixed_contrasts(_units(s, d), ["l_linenumber"], "y", "l_returnflag", "l_linestatus", "l_suppkey", nested="year")


@query("h12_additive_contrasts")
def _(s, d):
    return X.mixed_contrasts(_units(s, d), ["l_linenumber"], "y", "l_returnflag", "l_linestatus", "l_suppkey", nested="year", interaction=False)


@query(
    "h12_contrasts_without_subject_effect",
    f"""WITH u AS (SELECT l_linenumber, l_returnflag AS g, l_linestatus AS p, l_extendedprice / 1000 - avg(l_extendedprice / 1000) OVER (PARTITION BY l_linenumber, l_suppkey) AS y FROM lineitem),
c AS (SELECT l_linenumber, g, p, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM u GROUP BY 1, 2, 3),
v AS (SELECT l_linenumber, sum(n) - count(*) AS dof, sum(w) / (sum(n) - count(*)) AS s FROM c GROUP BY 1),
t AS (SELECT a.l_linenumber, a.p AS phase, a.g AS group_a, b.g AS group_b, a.m - b.m AS estimate, sqrt(s * (1 / a.n + 1 / b.n)) AS se, dof::DOUBLE AS dof FROM c a JOIN c b ON a.l_linenumber = b.l_linenumber AND a.p = b.p AND a.g < b.g JOIN v ON v.l_linenumber = a.l_linenumber)
SELECT l_linenumber, phase, group_a, group_b, round(estimate, 6) AS estimate, round(se, 6) AS se, dof, round({_student("estimate / se", "dof")}, 6) AS p_value FROM t""",
)
def _(s, d):
    # every supplier has the mean 0, so that REML finds no variance between suppliers and the fit is that of least squares
    rows = _units(s, d).withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("l_linenumber", "l_suppkey")))
    return rounded(X.mixed_contrasts(rows, ["l_linenumber"], "y", "l_returnflag", "l_linestatus", "l_suppkey").drop("low", "high"), "estimate", "se", "p_value", digits=6)


@query("h13_bonferroni", f"SELECT o_orderkey, round(least(1.0, p * count(*) OVER (PARTITION BY g)), 7) AS p_adjusted FROM ({_P})")
def _(s, d):
    return rounded(H.bonferroni(_p(s, d), "p", ["g"]).select("o_orderkey", "p_adjusted"), "p_adjusted")


@query("h14_stars", f"SELECT o_orderkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM ({_P})")
def _(s, d):
    return _p(s, d).select("o_orderkey", H.stars("p").alias("stars"))


@query("h15_result_table", f"SELECT o_orderkey, CASE WHEN p < 0.001 THEN '< 0.001' ELSE format('{{:.3f}}', p) END AS p_text, CASE g WHEN '1-URGENT' THEN 'urgent' ELSE g END AS label FROM ({_P}) WHERE p < 0.05")
def _(s, d):
    return _p(s, d).where("p < 0.05").replace({"1-URGENT": "urgent"}, subset=["g"]).select("o_orderkey", H.p_text("p").alias("p_text"), F.col("g").alias("label"))


_SBD = """e AS (SELECT user_id, i // 8 AS ev, i % 8 AS k, value AS x FROM {events}), t AS (SELECT user_id, k, avg(x) AS y FROM e WHERE ev < 3 GROUP BY 1, 2),
cc AS (SELECT e.user_id, e.ev, e.k - t.k AS lag, sum(x * y) AS c FROM e JOIN t ON t.user_id = e.user_id GROUP BY ALL),
dist AS (SELECT b.user_id, b.ev, 1 - best / nullif(nx * ny, 0) AS distance FROM (SELECT user_id, ev, max(c) AS best FROM cc GROUP BY 1, 2) b JOIN (SELECT user_id, ev, sqrt(sum(x * x)) AS nx FROM e GROUP BY 1, 2) n ON n.user_id = b.user_id AND n.ev = b.ev JOIN (SELECT user_id, sqrt(sum(y * y)) AS ny FROM t GROUP BY 1) m ON m.user_id = b.user_id)"""


def _distances(s, d):
    e = recordings(s, d).select("user_id", F.floor(F.col("i") / 8).alias("ev"), (F.col("i") % 8).alias("k"), F.col("value").alias("x"))
    t = e.where("ev < 3").groupBy("user_id", "k").agg(F.avg("x").alias("x"))
    return H.sbd_to_template(e, t, ["user_id"], "ev", "k", "x")


@query("h16_template_distance", "WITH " + _SBD + " SELECT user_id, ev, round(distance, 7) AS distance FROM dist")
def _(s, d):
    return rounded(_distances(s, d), "distance")


@query("h17_flag_similar", "WITH " + _SBD + ", q AS (SELECT user_id, quantile_cont(distance, 0.5) AS threshold FROM dist WHERE ev < 6 GROUP BY 1) SELECT dist.user_id, ev, round(threshold, 7) AS threshold FROM dist JOIN q ON q.user_id = dist.user_id WHERE distance <= threshold + 1e-9")
def _(s, d):
    out = H.flag_similar(_distances(s, d), ["user_id"], F.col("ev") < 6)
    return rounded(out.where(F.col("distance") <= F.col("threshold") + 1e-9).select("user_id", "ev", "threshold"), "threshold")


@query("h18_flagged_responses", "WITH " + _SBD + ", q AS (SELECT user_id, quantile_cont(distance, 0.5) AS threshold FROM dist WHERE ev < 6 GROUP BY 1), f AS (SELECT dist.user_id, ev FROM dist JOIN q ON q.user_id = dist.user_id WHERE distance <= threshold + 1e-9) SELECT e.user_id, e.ev, round(avg(x), 7) AS response FROM e JOIN f ON f.user_id = e.user_id AND f.ev = e.ev GROUP BY 1, 2")
def _(s, d):
    from ..operators.algebra import restrict

    flagged = H.flag_similar(_distances(s, d), ["user_id"], F.col("ev") < 6).where(F.col("distance") <= F.col("threshold") + 1e-9).select("user_id", "ev")
    e = recordings(s, d).select("user_id", F.floor(F.col("i") / 8).alias("ev"), "value")
    return rounded(restrict(e, flagged).groupBy("user_id", "ev").agg(F.avg("value").alias("response")), "response")


@query("h20_grid_count", "SELECT l_suppkey, l_linenumber, floor(l_extendedprice / 1000 / 10)::BIGINT AS ci, -ceil(l_quantity / 10)::BIGINT AS rj, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    p = T(s, d, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"))
    return H.grid_count(p, ["l_suppkey", "l_linenumber"], size=10)


@query(
    "h21_rotate_mirror",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 100 AS x, l_quantity * 10 AS y FROM lineitem), b AS (SELECT l_suppkey AS k, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM p GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cx - (y - cy) AS x, cy + (x - cx) AS y FROM p JOIN b ON k = l_suppkey), m AS (SELECT l_suppkey AS k, min(-ceil(y / 300)) AS lo, max(-ceil(y / 300)) AS hi FROM r GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 6) AS x, round(-300 * (lo + hi + 1) - y, 6) AS y FROM r JOIN m ON k = l_suppkey""",
)
def _(s, d):
    p = T(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice / 100 x", "l_quantity * 10 y")
    return rounded(H.mirror_y(H.rotate_ccw(p, ["l_suppkey"]), ["l_suppkey"]), "x", "y", digits=6)


@query("h22_mean_absent_zero", "WITH c AS (SELECT l_suppkey, l_linenumber, floor(l_extendedprice / 10000)::BIGINT AS ci, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), a AS (SELECT l_suppkey, ci, sum(n) / (SELECT count(DISTINCT l_linenumber) FROM c x WHERE x.l_suppkey = c.l_suppkey) AS v FROM c GROUP BY 1, 2) SELECT ci, round(sum(v) / (SELECT count(DISTINCT l_suppkey) FROM a), 7) AS mean FROM a GROUP BY 1")
def _(s, d):
    c = T(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 10000).alias("ci")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = H.mean_absent_zero(c, "l_linenumber", ["l_suppkey"], ["ci"], "n", out="v")
    return rounded(H.mean_absent_zero(per, "l_suppkey", [], ["ci"], "v"), "mean")


@query("h23_bounds", "SELECT min(l_linenumber) AS min_l_linenumber, max(l_linenumber) AS max_l_linenumber, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, max(l_extendedprice) AS max_value FROM lineitem")
def _(s, d):
    return H.bounds(T(s, d, "lineitem"), ["l_linenumber", "l_quantity"], "l_extendedprice")
