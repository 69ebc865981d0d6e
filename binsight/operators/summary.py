"""Aggregations over observation / prediction-log tables.

Sums are taken over ``decimal(18,2)`` so results do not depend on partitioning
or float summation order; means are the exact sum divided by the count.
Spark applies partial (map-side) aggregation to every aggregate here, so a hot
area or date is combined inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X

V = "predicted_weight_kg"
D = "prediction_date"


def _basic(value: str):
    return [F.count(F.lit(1)).alias("n"), X.exact_avg(value).alias("avg_weight")]


def _cells(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact partial figures per combination of keys, which grouping sets and distinct counts multiply cheaply."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_values"), F.sum(F.col(value).cast(X.EXACT)).alias("_sum"),
        F.min(value).alias("_low"), F.max(value).alias("_high"))


def _cells_avg():
    return (F.sum("_sum").cast("double") / F.sum("_values")).alias("avg_weight")


def stats_by_area(logs: DataFrame, k: int = 10, value: str = V) -> DataFrame:
    """Per area count and mean, top-k by count (ties by area)."""
    return (logs.groupBy("area").agg(*_basic(value))
            .orderBy(F.desc("n"), F.asc("area")).limit(k))


def stats_by_date(logs: DataFrame, k: int = 7, value: str = V, date: str = D) -> DataFrame:
    """Total per date, newest k dates."""
    return (logs.groupBy(date).agg(X.exact_sum(value).alias("total_weight"))
            .orderBy(F.desc(date)).limit(k))


def stats_overall(logs: DataFrame, value: str = V) -> DataFrame:
    """D3: one row with count and mean."""
    return logs.agg(F.count(F.lit(1)).alias("n"), X.exact_avg(value).alias("avg_weight"))


def _trend_aggs(value: str):
    return [F.count(F.lit(1)).alias("n"), X.exact_avg(value).alias("avg_weight"),
            X.exact_sum(value).alias("total_weight")]


def trend_daily(logs: DataFrame, as_of, days: int = 30, value: str = V, date: str = D) -> DataFrame:
    """Per date since ``as_of - days`` (no upper bound), ascending."""
    lo = F.date_sub(F.lit(as_of).cast("date"), days)
    return (logs.filter(F.col(date) >= lo).groupBy(date).agg(*_trend_aggs(value))
            .orderBy(date))


def trend_weekly(logs: DataFrame, k: int = 12, value: str = V, date: str = D) -> DataFrame:
    """Per `%Y-W%W` week, the k newest non-empty weeks, shown oldest first."""
    newest = (logs.groupBy(X.week_label(date).alias("week")).agg(*_trend_aggs(value))
              .orderBy(F.desc("week")).limit(k))
    return newest.orderBy("week")


def trend_monthly(logs: DataFrame, k: int = 12, value: str = V, date: str = D) -> DataFrame:
    """Per `%Y-%m` month, the k newest months, shown oldest first."""
    newest = (logs.groupBy(X.month_label(date).alias("month")).agg(*_trend_aggs(value))
              .orderBy(F.desc("month")).limit(k))
    return newest.orderBy("month")


def pattern_day_of_week(logs: DataFrame, value: str = V, date: str = D) -> DataFrame:
    """Sunday-first day-of-week profile."""
    g = logs.groupBy(X.weekday_sun0(date).alias("day_num")).agg(
        X.exact_avg(value).alias("avg_weight"), F.count(F.lit(1)).alias("n"))
    return g.select(X.day_name("day_num").alias("day_name"), "day_num", "avg_weight", "n").orderBy("day_num")


def pattern_month(logs: DataFrame, value: str = V, date: str = D) -> DataFrame:
    """Month-of-year seasonality."""
    g = logs.groupBy(F.month(date).cast("int").alias("month_num")).agg(
        X.exact_avg(value).alias("avg_weight"), F.count(F.lit(1)).alias("n"))
    return g.select(X.month_name("month_num").alias("month_name"), "month_num", "avg_weight", "n").orderBy("month_num")


def area_analysis(logs: DataFrame, value: str = V) -> DataFrame:
    """Per area count, mean, min, max, total, by total descending."""
    return (logs.groupBy("area").agg(
        F.count(F.lit(1)).alias("n"), X.exact_avg(value).alias("avg_weight"),
        F.min(value).alias("min_weight"), F.max(value).alias("max_weight"),
        X.exact_sum(value).alias("total_weight"))
        .orderBy(F.desc("total_weight"), F.asc("area")))


def summary(logs: DataFrame, value: str = V, approx_distinct: bool = False) -> DataFrame:
    """One-row summary; NULL (and 0) statistics reported as 0 like the
    reference.  ``approx_distinct`` swaps the exact distinct counts for HLL
    sketches on very large logs.

    The log is aggregated to (area, type) cells first, so that the distinct counts
    multiply the cells and not the rows."""
    cd = F.approx_count_distinct if approx_distinct else F.count_distinct
    s = _cells(logs, ["area", "waste_type"], value).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_predictions"), _cells_avg(),
        F.min("_low").alias("min_weight"), F.max("_high").alias("max_weight"),
        F.sum("_sum").cast("double").alias("total_weight"),
        cd("area").alias("unique_areas"), cd("waste_type").alias("unique_waste_types"))
    return s.select(
        "total_predictions",
        *[F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
          for c in ("avg_weight", "min_weight", "max_weight", "total_weight")],
        "unique_areas", "unique_waste_types")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of several tables as (table_name, n) rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def today_counts(logs: DataFrame, users: DataFrame, as_of, ts: str = "timestamp",
                 created: str = "created_at") -> DataFrame:
    """Predictions logged and users created on ``as_of`` (one row).
    ``cast(ts as date) = d`` is rewritten by Catalyst into a pushed range."""
    day = F.lit(as_of).cast("date")
    p = logs.filter(F.col(ts).cast("date") == day).agg(F.count(F.lit(1)).alias("predictions_today"))
    u = users.filter(F.col(created).cast("date") == day).agg(F.count(F.lit(1)).alias("new_users_today"))
    return p.crossJoin(u)  # 1 x 1 rows


def domains(df: DataFrame, columns=("area", "waste_type")) -> DataFrame:
    """Distinct values of each domain column as (domain, value) rows."""
    parts = [df.select(F.lit(c).alias("domain"), F.col(c).cast("string").alias("value")).distinct()
             for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("domain", "value")


def upload_stats(rows: DataFrame, k: int = 5, value: str = "weight") -> DataFrame:
    """For every user at once, top-k areas and top-k types by row count.

    The rows are aggregated to (user, area, type) cells, these with grouping sets; the per-user top-k runs on aggregated rows
    (at most #areas + #types per user) and Spark inserts a partial
    WindowGroupLimit before the shuffle.
    """
    from pyspark.sql import Window as W
    cells = _cells(rows, ["user_id", "area", "waste_type"], value)
    g = (cells.groupingSets([["user_id", "area"], ["user_id", "waste_type"]], "user_id", "area", "waste_type")
         .agg(F.sum("_n").alias("n"), _cells_avg(), F.grouping("area").alias("_ga")))
    g = g.select("user_id",
                 F.when(F.col("_ga") == 0, F.lit("area")).otherwise(F.lit("waste_type")).alias("dimension"),
                 F.when(F.col("_ga") == 0, F.col("area")).otherwise(F.col("waste_type")).alias("key"),
                 "n", "avg_weight")
    w = W.partitionBy("user_id", "dimension").orderBy(F.desc("n"), F.asc("key"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def user_profile(logs: DataFrame, value: str = V) -> DataFrame:
    """Count and mean per user, all users in one job."""
    return logs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), X.exact_avg(value).alias("avg_weight"))


def historical_averages(history: DataFrame, value: str = "net_weight_kg") -> DataFrame:
    """Mean by area, by waste type and overall in one pass (grouping sets over (area, type) cells).

    Output: level ('area' | 'waste_type' | 'overall'), key, n, avg_weight.
    """
    cells = _cells(history, ["area", "waste_type"], value)
    g = (cells.groupingSets([["area"], ["waste_type"], []], "area", "waste_type")
         .agg(F.coalesce(F.sum("_values"), F.lit(0)).alias("n"), _cells_avg(),
              F.grouping("area").alias("_ga"), F.grouping("waste_type").alias("_gt")))
    level = (F.when(F.col("_ga") == 0, F.lit("area"))
             .when(F.col("_gt") == 0, F.lit("waste_type")).otherwise(F.lit("overall")))
    key = F.when(F.col("_ga") == 0, F.col("area")).when(F.col("_gt") == 0, F.col("waste_type"))
    return g.select(level.alias("level"), key.alias("key"), "n", "avg_weight")


def upload_totals(rows: DataFrame, uploads: DataFrame) -> DataFrame:
    """D18 (totals): per user the number of uploaded records and uploads."""
    r = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_records"))
    u = uploads.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_uploads"))
    return (u.join(r, "user_id", "full_outer")
            .select("user_id", F.coalesce("total_records", F.lit(0)).alias("total_records"),
                    F.coalesce("total_uploads", F.lit(0)).alias("total_uploads")))


def user_list(users: DataFrame) -> DataFrame:
    """F2 + H20: all users newest first with their role label."""
    return (users.select("id", "username", "email", "created_at", X.role_label("is_admin").alias("role"))
            .orderBy(F.desc_nulls_last("created_at"), F.desc("id")))
