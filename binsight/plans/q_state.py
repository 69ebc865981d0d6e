"""Stored dashboard state (D1-D10, D17-D20) and table changes on partitioned tables (M1-M4, write side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.operators import partials as P
from binsight.operators import partitioned
from binsight.plans import oracle_views as V
from binsight.plans.catalog import (
    AS_OF_LONG, DELETE_TYPE, PERIOD_1, SNAPSHOT_CUTOFF, SQL, register)
from binsight.session import scratch_path
from binsight.sources import tables as T


def _state(rows, by: str, keys, value: str, date: str | None = None):
    """The rows as a base and two uploads, each merged into a stored state; the second upload is sent twice."""
    path = scratch_path(rows.sparkSession, "state")
    day = F.col(by).cast("date")
    lo, hi = (F.lit(d).cast("date") for d in PERIOD_1)
    base, first = rows.filter((day < lo) | day.isNull()), rows.filter((day >= lo) & (day <= hi))
    second = rows.filter(day > hi)
    for name, batch in (("base", base), ("upload-1", first), ("upload-2", second), ("upload-2", second)):
        P.add_batch(batch, path, name, keys, value, date)
    return P.stored(rows.sparkSession, path, keys)


def _logs(spark, d, keys=P.LOG_KEYS):
    return _state(T.prediction_logs(spark, d), "prediction_date", keys, "predicted_weight_kg", "prediction_date")


@register("state_summary", SQL["summary"])
def state_summary(spark, d):
    return P.summary(_logs(spark, d))


@register("state_overall", SQL["stats_overall"])
def state_overall(spark, d):
    return P.overall(_logs(spark, d))


@register("state_top_areas", SQL["stats_by_area"])
def state_top_areas(spark, d):
    return P.top_areas(_logs(spark, d))


@register("state_by_date", SQL["stats_by_date"])
def state_by_date(spark, d):
    return P.by_date(_logs(spark, d)).withColumnRenamed("day", "prediction_date")


@register("state_daily", f"""
WITH logs AS ({V.PREDICTION_LOGS})
SELECT prediction_date, COUNT(*) AS n, {V.exact_avg('predicted_weight_kg')} AS avg_weight,
       {V.exact_sum('predicted_weight_kg')} AS total_weight FROM logs
 WHERE prediction_date >= DATE '{AS_OF_LONG}' - INTERVAL 30 DAY GROUP BY prediction_date""")
def state_daily(spark, d):
    return P.trend_daily(_logs(spark, d), AS_OF_LONG).withColumnRenamed("day", "prediction_date")


@register("state_weekly", SQL["trend_weekly"])
def state_weekly(spark, d):
    return P.trend_weekly(_logs(spark, d))


@register("state_monthly", SQL["trend_monthly"])
def state_monthly(spark, d):
    return P.trend_monthly(_logs(spark, d))


@register("state_dow", SQL["pattern_dow"])
def state_dow(spark, d):
    return P.pattern_day_of_week(_logs(spark, d))


@register("state_month", SQL["pattern_month"])
def state_month(spark, d):
    return P.pattern_month(_logs(spark, d))


@register("state_area_analysis", SQL["area_analysis"])
def state_area_analysis(spark, d):
    return P.area_analysis(_logs(spark, d))


@register("state_user_profile", SQL["user_profile"])
def state_user_profile(spark, d):
    return P.user_profile(_logs(spark, d, P.USER_KEYS))


@register("state_historical", SQL["historical_averages"])
def state_historical(spark, d):
    return P.historical_averages(_state(T.observations(spark, d), "ticket_date", P.LOG_KEYS, "net_weight_kg",
                                        "ticket_date"))


@register("state_upload_stats", SQL["upload_stats"])
def state_upload_stats(spark, d):
    return P.upload_stats(_state(T.upload_rows(spark, d), "date", P.UPLOAD_KEYS, "weight"))


# ------------------------------------------------------------------ changes of touched partitions only

@register("partitioned_upsert", SQL["upsert_latest"])
def partitioned_upsert(spark, d):
    """Settings partitioned by their value; a key whose value changes moves to another partition."""
    s = T.keyed_snapshots(spark, d)
    cut = F.lit(SNAPSHOT_CUTOFF).cast("timestamp_ntz")
    before = s.filter(F.col("updated_at") < cut)
    newest = before.groupBy("key").agg(F.max_by(F.struct("value", "updated_at", "change_id"),
                                                F.struct("updated_at", "change_id")).alias("_r")).select("key", "_r.*")
    path = scratch_path(spark, "settings")
    partitioned.write_table(newest, path, "value")
    partitioned.upsert(spark, path, s.filter(F.col("updated_at") >= cut), "key", ["updated_at", "change_id"], "value")
    return partitioned.read_table(spark, path, s.schema)


_MONTHLY = f"""WITH logs AS ({V.PREDICTION_LOGS})
SELECT *, strftime(prediction_date, '%Y-%m') AS month FROM logs"""


def _monthly(spark, d):
    logs = T.prediction_logs(spark, d).withColumn("month", X.month_label("prediction_date"))
    path = scratch_path(spark, "logs")
    partitioned.write_table(logs, path, "month")
    return logs.schema, path


@register("partitioned_delete", _MONTHLY + f"""
 WHERE NOT COALESCE(waste_type = '{DELETE_TYPE}' AND prediction_date BETWEEN DATE '{PERIOD_1[0]}' AND DATE '{PERIOD_1[1]}', FALSE)""")
def partitioned_delete(spark, d):
    """One type's rows of one period go from logs partitioned by month."""
    schema, path = _monthly(spark, d)
    gone = (F.col("waste_type") == DELETE_TYPE) & F.col("prediction_date").between(
        *[F.lit(x).cast("date") for x in PERIOD_1])
    partitioned.delete(spark, path, schema, gone, "month")
    return partitioned.read_table(spark, path, schema)


@register("partitioned_cascade", _MONTHLY + """
 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal <= 0)""")
def partitioned_cascade(spark, d):
    """The log rows of deleted users go from logs partitioned by month."""
    schema, path = _monthly(spark, d)
    users = T.read(spark, d, "customer").filter(F.col("c_acctbal") <= 0).select(F.col("c_custkey").alias("id"))
    partitioned.delete_keys(spark, path, schema, users, "user_id", "month")
    return partitioned.read_table(spark, path, schema)


@register("partitioned_update", SQL["update_by_key"])
def partitioned_update(spark, d):
    """Uploads partitioned by status; those with rows are completed and move."""
    up = T.uploads(spark, d).select("id", "user_id", "filename", "status", F.lit(0).cast("bigint").alias("record_count"))
    counts = (T.upload_rows(spark, d).groupBy(F.col("upload_id").alias("id"))
              .agg(F.lit("completed").alias("status"), F.count(F.lit(1)).alias("record_count")))
    path = scratch_path(spark, "uploads")
    partitioned.write_table(up, path, "status")
    partitioned.update(spark, path, up.schema, counts, "id", ["status", "record_count"], "status")
    return partitioned.read_table(spark, path, up.schema)
