"""Session metadata: customers as subjects, orders as sessions; and the flagship from event log to phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators.signal import trials_from_events
from .registry import query, recordings, rounded, table as T

_ROLES = {"t_start": "signup", "t_servo_in": "view", "t_cue": "click"}

TRIALS_SQL = """trials AS (
  SELECT * FROM (
    SELECT user_id, k AS trial_id, max(t) FILTER (role = 'a') AS t_start, max(t) FILTER (role = 'b') AS t_servo_in, max(t) FILTER (role = 'c') AS t_cue,
      max(t) FILTER (role = 'd') AS t_servo_out, max(event_type) FILTER (role = 'd') = 'purchase' AS successful,
      lead(max(t) FILTER (role = 'a')) OVER (PARTITION BY user_id ORDER BY k) AS t_end
    FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, role ORDER BY t) - 1 AS k
      FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'a' WHEN 'view' THEN 'b' WHEN 'click' THEN 'c' ELSE 'd' END AS role FROM {events})
    ) GROUP BY user_id, k
  ) WHERE t_start IS NOT NULL AND t_servo_in IS NOT NULL AND t_cue IS NOT NULL AND t_servo_out IS NOT NULL AND t_end IS NOT NULL
)"""


def trials(s, d):
    return trials_from_events(recordings(s, d), ["user_id"], "t", "event_type", _ROLES, fail="error", auto="autoreward", reward="purchase")


@query("d2_trials", "WITH " + TRIALS_SQL + " SELECT user_id, trial_id, t_start, t_servo_in, t_cue, t_servo_out, t_end, successful FROM trials")
def _(s, d):
    return trials(s, d).drop("autoreward")


@query("c8_performance", "WITH " + TRIALS_SQL + " SELECT user_id, round(avg(successful::INT), 6) AS performance FROM trials GROUP BY 1")
def _(s, d):
    return rounded(S.performance(trials(s, d), ["user_id"]), "performance", digits=6)


_DAYS = """perf AS (SELECT user_id, avg(successful::INT) AS performance FROM trials GROUP BY 1),
days AS (SELECT u.user_id, u.user_id % 7 AS mouse, date_diff('day', DATE '2024-01-05', u.day) AS days FROM (SELECT user_id, CAST(min(ts) AS DATE) + CAST(user_id % 20 AS INT) - 10 AS day FROM events GROUP BY 1) u),
norm AS (SELECT *, CASE WHEN days < 0 THEN -rank() OVER (PARTITION BY mouse, days < 0 ORDER BY days DESC) ELSE days END AS norm FROM days)"""


def _phases(s, d):
    first = T(s, d, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("day"))
    sessions = first.withColumn("day", F.date_add("day", (F.col("user_id") % 20 - 10).cast("int"))).withColumn("mouse", F.col("user_id") % 7)
    strokes = sessions.select("mouse").distinct().withColumn("event_day", F.lit("2024-01-05").cast("date"))
    days = S.normalise_days(S.days_from(sessions, strokes, ["mouse"], "day", "event_day"), ["mouse"])
    return S.performance(trials(s, d), ["user_id"]).join(days, "user_id")


@query(
    "c9_phase",
    "WITH " + TRIALS_SQL + ", " + _DAYS + """
SELECT user_id, mouse, days, norm, round(performance, 6) AS performance,
  CASE WHEN performance >= 0.5 AND days <= 0 AND norm >= -3 THEN 'Expert' WHEN days <= 0 THEN 'Learning' WHEN days <= 10 THEN 'Early' WHEN days > 7 THEN 'Late' END AS phase
FROM perf JOIN norm USING (user_id)""",
)
def _(s, d):
    out = _phases(s, d).withColumn("phase", S.phase("performance", "days", "norm", thr=0.5))
    return rounded(out.select("user_id", "mouse", "days", "norm", "performance", "phase"), "performance", digits=6)


@query("c1_session_id", "SELECT o_orderkey, format('session_{}_M{:03d}_{}_{:02d}', lower(o_orderstatus), o_custkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey % 10) AS session_id FROM orders")
def _(s, d):
    o = T(s, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("user"), "o_custkey", "o_orderdate", (F.col("o_orderkey") % 10).alias("num"))
    return o.select("o_orderkey", S.session_id("user", "o_custkey", "o_orderdate", "num").alias("session_id"))


@query("c2_age", "SELECT o_orderkey, date_diff('day', DATE '1994-12-01', CAST(o_orderdate AS DATE)) AS age FROM orders")
def _(s, d):
    return T(s, d, "orders").select("o_orderkey", F.lit("1994-12-01").cast("date").alias("dob"), "o_orderdate").select("o_orderkey", S.age_days("dob", "o_orderdate").alias("age"))


_WEIGHTS = """weight AS (SELECT o_custkey AS mouse_id, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS weight FROM orders GROUP BY 1, 2),
thr AS (SELECT s.mouse_id, w.weight * 0.85 AS threshold FROM (SELECT o_custkey AS mouse_id, arg_max(CAST(o_orderdate AS DATE), o_orderkey) AS day FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s LEFT JOIN weight w ON w.mouse_id = s.mouse_id AND w.day = s.day)"""


def _weights(s, d):
    o = T(s, d, "orders").select(F.col("o_custkey").alias("mouse_id"), F.to_date("o_orderdate").alias("date_of_weight"), "o_totalprice", "o_orderkey", "o_orderstatus")
    weight = o.groupBy("mouse_id", "date_of_weight").agg(F.avg("o_totalprice").alias("weight"))
    surgery = o.where("o_orderstatus = 'F'").select("mouse_id", F.col("date_of_weight").alias("surgery_date"), F.col("o_orderkey").alias("surgery_num"))
    return weight, S.weight_threshold(surgery, weight, ["mouse_id"])


@query("c3_weight_threshold", "WITH " + _WEIGHTS + " SELECT mouse_id, round(threshold, 7) AS threshold FROM thr")
def _(s, d):
    return rounded(_weights(s, d)[1], "threshold")


@query("c4_below_threshold", "WITH " + _WEIGHTS + " SELECT mouse_id, day AS date_of_weight, round(weight, 7) AS weight FROM weight JOIN thr USING (mouse_id) WHERE weight < threshold")
def _(s, d):
    return rounded(S.below_threshold(*_weights(s, d), ["mouse_id"]).select("mouse_id", "date_of_weight", "weight"), "weight")


@query("c5_relative_weight", "WITH " + _WEIGHTS + " SELECT mouse_id, day AS date_of_weight, round(weight / (threshold / 0.85), 6) AS relative FROM weight JOIN thr USING (mouse_id)")
def _(s, d):
    return rounded(S.relative_weight(*_weights(s, d), ["mouse_id"]).select("mouse_id", "date_of_weight", "relative"), "relative", digits=6)


_ORDER_DAYS = "SELECT o_orderkey, o_custkey, date_diff('day', CAST('1998-01-01' AS DATE) + CAST(o_custkey % 90 AS INT), CAST(o_orderdate AS DATE)) AS days FROM orders"


def _order_days(s, d):
    o = T(s, d, "orders")
    strokes = o.select("o_custkey").distinct().withColumn("stroke", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("o_custkey") % 90).cast("int")))
    return S.days_from(o, strokes, ["o_custkey"], "o_orderdate", "stroke").select("o_orderkey", "o_custkey", "days")


@query("c6_days_from", _ORDER_DAYS)
def _(s, d):
    return _order_days(s, d)


@query("c7_normalised_days", f"SELECT *, CASE WHEN days < 0 THEN -rank() OVER (PARTITION BY o_custkey, days < 0 ORDER BY days DESC) ELSE days END AS norm FROM ({_ORDER_DAYS})")
def _(s, d):
    return S.normalise_days(_order_days(s, d), ["o_custkey"])


@query("c10_side", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END THEN 'ipsi' ELSE 'contra' END AS side, CASE WHEN split_part(l_returnflag || '_' || l_linestatus, '_', 2) = 'O' THEN 'ipsi' ELSE 'contra' END AS hemisphere FROM lineitem")
def _(s, d):
    rows = T(s, d, "lineitem").withColumns({"handedness": F.when(F.col("l_linestatus") == "O", "N").otherwise("A"), "roi": F.concat_ws("_", "l_returnflag", "l_linestatus"), "lesion": F.lit("O")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.side("l_returnflag", "handedness").alias("side"), S.hemisphere("roi", "lesion").alias("hemisphere"))


_CATALOG = f"SELECT o_orderkey, o_custkey AS mouse_id, days, o_orderstatus AS phase, c_mktsegment AS stroke_group FROM ({_ORDER_DAYS}) JOIN (SELECT o_orderkey, o_orderstatus FROM orders) USING (o_orderkey) JOIN customer ON c_custkey = o_custkey"


def _catalog(s, d):
    c = T(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("stroke_group"))
    out = _order_days(s, d).join(T(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("phase")), "o_orderkey").join(c, "o_custkey")
    return out.withColumnRenamed("o_custkey", "mouse_id")


@query("c11_select_sessions", f"SELECT * FROM ({_CATALOG}) WHERE days IN (-7, -6, -5, -4, -3, -2, -1, 1, 2, 3, 7, 14, 21) AND phase IN ('F', 'O') AND stroke_group IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND mouse_id >= 10")
def _(s, d):
    return S.select_sessions(_catalog(s, d), [-7, -6, -5, -4, -3, -2, -1, 1, 2, 3, 7, 14, 21], ["F", "O"], ["BUILDING", "MACHINERY", "HOUSEHOLD"], 10)


@query("c12_imaged", f"SELECT o_orderkey, days FROM ({_ORDER_DAYS}) WHERE days NOT IN (8, 10, 15, 17, 22, 24)")
def _(s, d):
    return S.imaged_sessions(_order_days(s, d)).select("o_orderkey", "days")


@query("c13_dataset_info", f"SELECT o_orderkey, CASE phase WHEN 'F' THEN 'Expert' WHEN 'O' THEN 'Early' ELSE phase END AS phase, CASE stroke_group WHEN 'BUILDING' THEN 'Stroke' WHEN 'MACHINERY' THEN 'Sham' ELSE stroke_group END AS stroke_group, CASE stroke_group WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END AS group_rank FROM ({_CATALOG})")
def _(s, d):
    return S.dataset_info(_catalog(s, d), {"F": "Expert", "O": "Early"}, {"BUILDING": "Stroke", "MACHINERY": "Sham"}, ["Sham", "Stroke"]).select("o_orderkey", "phase", "stroke_group", "group_rank")
