"""Period comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.operators import compare
from binsight.plans import oracle_views as V
from binsight.plans.catalog import AS_OF_RECENT, COMPARE_TYPE, PERIOD_1, PERIOD_2, register
from binsight.sources import tables as T

_C = V.cents("predicted_weight_kg")


def _between(lo, hi):
    return f"prediction_date BETWEEN DATE '{lo}' AND DATE '{hi}'"


def _period_sql(p, lo, hi):
    c = _between(lo, hi)
    return (f"COUNT(CASE WHEN {c} THEN 1 END) AS {p}_n, COUNT(CASE WHEN {c} THEN predicted_weight_kg END) AS {p}_v, SUM(CASE WHEN {c} THEN {_C} END) AS {p}_sc, "
            f"MIN(CASE WHEN {c} THEN {_C} END) AS {p}_minc, MAX(CASE WHEN {c} THEN {_C} END) AS {p}_maxc")


def _period_out(p):
    ac = V.half_up_div(f"{p}_sc", f"{p}_v")
    h = f"{p}_n > 0"
    return (f"CASE WHEN {h} THEN {p}_n END AS {p}_count, "
            f"CASE WHEN {h} THEN CAST({ac} AS DOUBLE) / 100.0 END AS {p}_avg, "
            f"CASE WHEN {h} THEN CAST({p}_sc AS DOUBLE) / 100.0 END AS {p}_total, "
            f"CASE WHEN {h} THEN CAST({p}_minc AS DOUBLE) / 100.0 END AS {p}_min, "
            f"CASE WHEN {h} THEN CAST({p}_maxc AS DOUBLE) / 100.0 END AS {p}_max, "
            f"CASE WHEN {h} THEN {ac} END AS {p}_avgc")


_COMPARE_SQL = f"""
WITH logs AS ({V.PREDICTION_LOGS}),
g AS (SELECT {_period_sql('p1', *PERIOD_1)}, {_period_sql('p2', *PERIOD_2)}
        FROM logs WHERE waste_type = '{COMPARE_TYPE}'
         AND ({_between(*PERIOD_1)} OR {_between(*PERIOD_2)})),
h AS (SELECT {_period_out('p1')}, {_period_out('p2')}, p1_sc, p2_sc FROM g)
SELECT p1_count, p1_avg, p1_total, p1_min, p1_max, p2_count, p2_avg, p2_total, p2_min, p2_max,
       CASE WHEN p1_count > 0 AND p2_count > 0 THEN {V.pct_change('p1_count', 'p2_count')} END AS count_change,
       CASE WHEN p1_count > 0 AND p2_count > 0 THEN {V.pct_change('p1_avgc', 'p2_avgc')} END AS avg_change,
       CASE WHEN p1_count > 0 AND p2_count > 0 THEN {V.pct_change('p1_sc', 'p2_sc')} END AS total_change,
       CASE WHEN p1_count > 0 AND p2_count > 0 THEN CAST(p2_avgc - p1_avgc AS DOUBLE) / 100.0 END AS avg_diff,
       CASE WHEN p1_count > 0 AND p2_count > 0 THEN CAST(p2_sc - p1_sc AS DOUBLE) / 100.0 END AS total_diff
  FROM h"""


@register("compare_periods", _COMPARE_SQL)
def compare_periods(spark, d):
    return compare.compare_periods(T.prediction_logs(spark, d), PERIOD_1, PERIOD_2, waste_type=COMPARE_TYPE)


@register("compare_rows", f"""
WITH logs AS ({V.PREDICTION_LOGS})
SELECT 'period1' AS period, id, prediction_date, predicted_weight_kg, area, waste_type FROM logs WHERE {_between(*PERIOD_1)}
UNION ALL
SELECT 'period2', id, prediction_date, predicted_weight_kg, area, waste_type FROM logs WHERE {_between(*PERIOD_2)}
ORDER BY 1, 3, 2""")
def compare_rows(spark, d):
    return compare.compare_rows(T.prediction_logs(spark, d), spark, PERIOD_1, PERIOD_2)


def _quick_sql():
    parts = []
    for k in ("week", "month", "year"):
        cur, prev = compare.quick_periods(AS_OF_RECENT, k)
        def agg(tag, lo, hi):
            c = _between(lo, hi)
            return (f"COUNT(CASE WHEN {c} THEN 1 END) AS {tag}_n, COUNT(CASE WHEN {c} THEN predicted_weight_kg END) AS {tag}_v, "
                    f"COALESCE(SUM(CASE WHEN {c} THEN {_C} END), 0) AS {tag}_sc")
        inner = f"SELECT {agg('cur', *cur)}, {agg('prev', *prev)} FROM logs"
        cur_ac = f"COALESCE({V.half_up_div('cur_sc', 'cur_v')}, 0)"
        prev_ac = f"COALESCE({V.half_up_div('prev_sc', 'prev_v')}, 0)"
        parts.append(f"""SELECT '{k}' AS period, cur_n AS current_count,
       CAST({cur_ac} AS DOUBLE) / 100.0 AS current_avg, CAST(cur_sc AS DOUBLE) / 100.0 AS current_total,
       prev_n AS previous_count, CAST({prev_ac} AS DOUBLE) / 100.0 AS previous_avg,
       CAST(prev_sc AS DOUBLE) / 100.0 AS previous_total,
       {V.pct_change('prev_n', 'cur_n')} AS count_change,
       {V.pct_change(prev_ac, cur_ac)} AS avg_change,
       {V.pct_change('prev_sc', 'cur_sc')} AS total_change
  FROM ({inner})""")
    return f"WITH logs AS ({V.RECENT_LOGS})\n" + "\nUNION ALL\n".join(parts)


@register("quick_compare", _quick_sql())
def quick_compare(spark, d):
    return compare.quick_compare(T.recent_logs(spark, d), AS_OF_RECENT)


@register("pct_change", f"""
WITH logs AS ({V.PREDICTION_LOGS}),
g AS (SELECT area, COUNT(CASE WHEN {_between(*PERIOD_1)} THEN 1 END) AS n1,
             COUNT(CASE WHEN {_between(*PERIOD_2)} THEN 1 END) AS n2,
             COALESCE(SUM(CASE WHEN {_between(*PERIOD_1)} THEN {_C} END), 0) AS s1,
             COALESCE(SUM(CASE WHEN {_between(*PERIOD_2)} THEN {_C} END), 0) AS s2
        FROM logs WHERE prediction_date BETWEEN DATE '{PERIOD_1[0]}' AND DATE '{PERIOD_2[1]}' GROUP BY area)
SELECT area, n1 AS count_1, n2 AS count_2, CAST(s1 AS DOUBLE) / 100.0 AS total_1,
       CAST(s2 AS DOUBLE) / 100.0 AS total_2, {V.pct_change('n1', 'n2')} AS count_change,
       {V.pct_change('s1', 's2')} AS total_change
  FROM g""")
def pct_change(spark, d):
    return compare.change_by_key(T.prediction_logs(spark, d), "area", PERIOD_1, PERIOD_2)


@register("order_periods", f"""
WITH daily AS (SELECT prediction_date, COUNT(*) AS n, SUM({_C}) AS cents FROM ({V.PREDICTION_LOGS}) GROUP BY prediction_date),
periods AS (SELECT o_orderkey AS period, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS hi FROM orders)
SELECT period, lo, hi, CAST(SUM(n) AS BIGINT) AS logs, CAST(SUM(cents) AS DOUBLE) / 100.0 AS total, MIN(prediction_date) AS first_date,
       MAX(prediction_date) AS last_date
  FROM periods JOIN daily ON prediction_date BETWEEN lo AND hi GROUP BY period, lo, hi""")
def order_periods(spark, d):
    """C5 with a period for each order (up to 60 days): the log is summed up by day before the join."""
    daily = T.prediction_logs(spark, d).groupBy("prediction_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.to_cents("predicted_weight_kg")).alias("cents"))
    start = F.col("o_orderdate").cast("date")
    periods = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("period"), start.alias("lo"), F.date_add(start, (F.col("o_orderkey") % 60).cast("int")).alias("hi"))
    met = compare.interval_join(daily, periods, "prediction_date").groupBy("period", "lo", "hi")
    return met.agg(F.sum("n").alias("logs"), (F.sum("cents").cast("double") / 100.0).alias("total"),
                   F.min("prediction_date").alias("first_date"), F.max("prediction_date").alias("last_date"))
