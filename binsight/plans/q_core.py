"""Benchmark join and the dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.operators import joins, summary
from binsight.plans import oracle_views as V
from binsight.plans.catalog import AS_OF_RECENT, AS_OF_SIGNUPS, register
from binsight.sources import tables as T

_AVG_FALLBACK = "COALESCE(NULLIF({c}, 0), r.prediction)"

_BENCH_SQL = f"""
WITH hist AS ({V.OBSERVATIONS}),
a AS (SELECT area, {V.exact_avg('net_weight_kg')} AS v FROM hist GROUP BY area),
t AS (SELECT waste_type, {V.exact_avg('net_weight_kg')} AS v FROM hist GROUP BY waste_type),
o AS (SELECT {V.exact_avg('net_weight_kg')} AS v FROM hist),
r AS ({V.SCORED_REQUESTS}),
s AS (
SELECT r.l_orderkey, r.l_linenumber, r.area, r.waste_type, r.prediction,
       {_AVG_FALLBACK.format(c='a.v')} AS area_avg,
       {_AVG_FALLBACK.format(c='t.v')} AS type_avg,
       {_AVG_FALLBACK.format(c='o.v')} AS overall_avg
  FROM r LEFT JOIN a ON r.area = a.area LEFT JOIN t ON r.waste_type = t.waste_type CROSS JOIN o)
"""


def _bench(spark, d):
    return joins.benchmark_against_history(T.scored_requests(spark, d), T.observations(spark, d))


@register("score_benchmark", _BENCH_SQL + "SELECT * FROM s")
def score_benchmark(spark, d):
    return _bench(spark, d)


@register("prediction_band", _BENCH_SQL + """
SELECT s.*, greatest(prediction, area_avg, overall_avg) * 1.2 AS gauge_max,
       prediction / (greatest(prediction, area_avg, overall_avg) * 1.2) * 100.0 AS gauge_pct,
       CASE WHEN prediction > area_avg * 1.3 THEN 'red'
            WHEN prediction > area_avg * 1.1 THEN 'amber' ELSE 'green' END AS band
  FROM s""")
def prediction_band(spark, d):
    return joins.prediction_band(_bench(spark, d))


@register("historical_averages", f"""
WITH h AS ({V.OBSERVATIONS})
SELECT 'area' AS level, area AS key, COUNT(net_weight_kg) AS n, {V.exact_avg('net_weight_kg')} AS avg_weight FROM h GROUP BY area
UNION ALL
SELECT 'waste_type', waste_type, COUNT(net_weight_kg), {V.exact_avg('net_weight_kg')} FROM h GROUP BY waste_type
UNION ALL
SELECT 'overall', NULL, COUNT(net_weight_kg), {V.exact_avg('net_weight_kg')} FROM h""")
def historical_averages(spark, d):
    return summary.historical_averages(T.observations(spark, d))


_LOGS = f"WITH logs AS ({V.PREDICTION_LOGS})\n"
_RECENT = f"WITH logs AS ({V.RECENT_LOGS})\n"
_AVG = V.exact_avg("predicted_weight_kg")
_SUM = V.exact_sum("predicted_weight_kg")


@register("stats_by_area", _LOGS + f"""
SELECT area, COUNT(*) AS n, {_AVG} AS avg_weight FROM logs GROUP BY area
 ORDER BY n DESC, area LIMIT 10""")
def stats_by_area(spark, d):
    return summary.stats_by_area(T.prediction_logs(spark, d))


@register("top_areas", _LOGS + f"""
SELECT area, COUNT(*) AS n, {_AVG} AS avg_weight FROM logs GROUP BY area
 ORDER BY n DESC, area LIMIT 5""")
def top_areas(spark, d):
    return summary.stats_by_area(T.prediction_logs(spark, d), k=5)


@register("stats_by_date", _LOGS + f"""
SELECT prediction_date, {_SUM} AS total_weight FROM logs GROUP BY prediction_date
 ORDER BY prediction_date DESC LIMIT 7""")
def stats_by_date(spark, d):
    return summary.stats_by_date(T.prediction_logs(spark, d))


@register("stats_overall", _LOGS + f"SELECT COUNT(*) AS n, {_AVG} AS avg_weight FROM logs")
def stats_overall(spark, d):
    return summary.stats_overall(T.prediction_logs(spark, d))


_TREND = f"COUNT(*) AS n, {_AVG} AS avg_weight, {_SUM} AS total_weight"


@register("trend_daily", _RECENT + f"""
SELECT prediction_date, {_TREND} FROM logs
 WHERE prediction_date >= DATE '{AS_OF_RECENT}' - INTERVAL 30 DAY
 GROUP BY prediction_date ORDER BY prediction_date""")
def trend_daily(spark, d):
    return summary.trend_daily(T.recent_logs(spark, d), AS_OF_RECENT)


@register("trend_weekly", _LOGS + f"""
SELECT * FROM (SELECT {V.week_label('prediction_date')} AS week, {_TREND} FROM logs
 GROUP BY week ORDER BY week DESC LIMIT 12) ORDER BY week""")
def trend_weekly(spark, d):
    return summary.trend_weekly(T.prediction_logs(spark, d))


@register("trend_monthly", _LOGS + f"""
SELECT * FROM (SELECT strftime(prediction_date, '%Y-%m') AS month, {_TREND} FROM logs
 GROUP BY month ORDER BY month DESC LIMIT 12) ORDER BY month""")
def trend_monthly(spark, d):
    return summary.trend_monthly(T.prediction_logs(spark, d))


@register("pattern_dow", _LOGS + f"""
SELECT CASE day_num WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday'
         WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END AS day_name,
       day_num, avg_weight, n
  FROM (SELECT CAST(dayofweek(prediction_date) AS INTEGER) AS day_num, {_AVG} AS avg_weight, COUNT(*) AS n
          FROM logs GROUP BY day_num) ORDER BY day_num""")
def pattern_dow(spark, d):
    return summary.pattern_day_of_week(T.prediction_logs(spark, d))


@register("pattern_month", _LOGS + f"""
SELECT strftime(make_date(2000, month_num, 1), '%b') AS month_name, month_num, avg_weight, n
  FROM (SELECT CAST(month(prediction_date) AS INTEGER) AS month_num, {_AVG} AS avg_weight, COUNT(*) AS n
          FROM logs GROUP BY month_num) ORDER BY month_num""")
def pattern_month(spark, d):
    return summary.pattern_month(T.prediction_logs(spark, d))


@register("area_analysis", _LOGS + f"""
SELECT area, COUNT(*) AS n, {_AVG} AS avg_weight, MIN(predicted_weight_kg) AS min_weight,
       MAX(predicted_weight_kg) AS max_weight, {_SUM} AS total_weight
  FROM logs GROUP BY area ORDER BY total_weight DESC, area""")
def area_analysis(spark, d):
    return summary.area_analysis(T.prediction_logs(spark, d))


@register("summary", _LOGS + f"""
SELECT total_predictions,
       COALESCE(NULLIF(avg_weight, 0), 0.0) AS avg_weight, COALESCE(NULLIF(min_weight, 0), 0.0) AS min_weight,
       COALESCE(NULLIF(max_weight, 0), 0.0) AS max_weight, COALESCE(NULLIF(total_weight, 0), 0.0) AS total_weight,
       unique_areas, unique_waste_types
  FROM (SELECT COUNT(*) AS total_predictions, {_AVG} AS avg_weight, MIN(predicted_weight_kg) AS min_weight,
               MAX(predicted_weight_kg) AS max_weight, {_SUM} AS total_weight,
               COUNT(DISTINCT area) AS unique_areas, COUNT(DISTINCT waste_type) AS unique_waste_types
          FROM logs)""")
def summary_q(spark, d):
    return summary.summary(T.prediction_logs(spark, d))


@register("table_counts", f"""
SELECT 'users' AS table_name, COUNT(*) AS n FROM customer
UNION ALL SELECT 'prediction_logs', COUNT(*) FROM ({V.PREDICTION_LOGS})
UNION ALL SELECT 'training_data', COUNT(*) FROM ({V.OBSERVATIONS})
UNION ALL SELECT 'user_uploads', COUNT(*) FROM orders
UNION ALL SELECT 'user_data', COUNT(*) FROM ({V.UPLOAD_ROWS})""")
def table_counts(spark, d):
    return summary.table_counts({
        "users": T.users(spark, d), "prediction_logs": T.prediction_logs(spark, d),
        "training_data": T.observations(spark, d), "user_uploads": T.uploads(spark, d),
        "user_data": T.upload_rows(spark, d)})


@register("today_counts", f"""
SELECT (SELECT COUNT(*) FROM ({V.PREDICTION_LOGS}) WHERE CAST("timestamp" AS DATE) = DATE '{AS_OF_SIGNUPS}') AS predictions_today,
       (SELECT COUNT(*) FROM ({V.USERS}) WHERE CAST(created_at AS DATE) = DATE '{AS_OF_SIGNUPS}') AS new_users_today""")
def today_counts(spark, d):
    return summary.today_counts(T.prediction_logs(spark, d), T.users(spark, d), AS_OF_SIGNUPS)


@register("domains", _LOGS + """
SELECT * FROM (SELECT DISTINCT 'area' AS domain, area AS value FROM logs
               UNION ALL SELECT DISTINCT 'waste_type', waste_type FROM logs) ORDER BY domain, value""")
def domains_q(spark, d):
    return summary.domains(T.prediction_logs(spark, d))


@register("upload_stats", f"""
WITH r AS ({V.UPLOAD_ROWS}),
g AS (SELECT user_id, 'area' AS dimension, area AS key, COUNT(*) AS n, {V.exact_avg('weight')} AS avg_weight
        FROM r GROUP BY user_id, area
      UNION ALL
      SELECT user_id, 'waste_type', waste_type, COUNT(*), {V.exact_avg('weight')}
        FROM r GROUP BY user_id, waste_type)
SELECT * FROM (SELECT g.*, CAST(row_number() OVER (PARTITION BY user_id, dimension ORDER BY n DESC, key) AS INTEGER) AS rank
                 FROM g) WHERE rank <= 5""")
def upload_stats(spark, d):
    return summary.upload_stats(T.upload_rows(spark, d))


@register("user_profile", _LOGS + f"SELECT user_id, COUNT(*) AS n, {_AVG} AS avg_weight FROM logs GROUP BY user_id")
def user_profile(spark, d):
    return summary.user_profile(T.prediction_logs(spark, d))


@register("round_presentation", _LOGS + f"""
SELECT area, n, CAST({V.half_up_div('sc', 'v')} AS DOUBLE) / 100.0 AS avg_weight,
       CAST(sc AS DOUBLE) / 100.0 AS total_weight, CAST(mn AS DOUBLE) / 100.0 AS min_weight,
       CAST(mx AS DOUBLE) / 100.0 AS max_weight
  FROM (SELECT area, COUNT(*) AS n, COUNT(predicted_weight_kg) AS v, SUM({V.cents('predicted_weight_kg')}) AS sc,
               MIN({V.cents('predicted_weight_kg')}) AS mn, MAX({V.cents('predicted_weight_kg')}) AS mx
          FROM logs GROUP BY area)""")
def round_presentation(spark, d):
    """The area analysis rounded for display, HALF_UP to cents, exactly."""
    logs = T.prediction_logs(spark, d)
    c = X.to_cents("predicted_weight_kg")
    g = logs.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.count("predicted_weight_kg").alias("v"), F.sum(c).alias("sc"),
                                 F.min(c).alias("mn"), F.max(c).alias("mx"))
    return g.select("area", "n", X.round2_avg_from_cents("sc", "v").alias("avg_weight"),
                    (F.col("sc").cast("double") / F.lit(100.0)).alias("total_weight"),
                    (F.col("mn").cast("double") / F.lit(100.0)).alias("min_weight"),
                    (F.col("mx").cast("double") / F.lit(100.0)).alias("max_weight"))


@register("upload_totals", f"""
WITH r AS (SELECT user_id, COUNT(*) AS total_records FROM ({V.UPLOAD_ROWS}) GROUP BY user_id),
u AS (SELECT user_id, COUNT(*) AS total_uploads FROM ({V.UPLOADS}) GROUP BY user_id)
SELECT COALESCE(u.user_id, r.user_id) AS user_id, COALESCE(r.total_records, 0) AS total_records,
       COALESCE(u.total_uploads, 0) AS total_uploads
  FROM u FULL OUTER JOIN r ON u.user_id = r.user_id""")
def upload_totals(spark, d):
    return summary.upload_totals(T.upload_rows(spark, d), T.uploads(spark, d))


@register("user_list", f"""
SELECT id, username, email, created_at, CASE WHEN is_admin THEN 'Admin' ELSE 'User' END AS role
  FROM ({V.USERS}) ORDER BY created_at DESC NULLS LAST, id DESC""")
def user_list(spark, d):
    return summary.user_list(T.users(spark, d))
