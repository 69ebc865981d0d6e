"""Mergeable dashboard state: stored partial sums that new batches are merged into.

A state table holds, for each combination of its keys, the number of rows, the
number of values, their exact sum, least and greatest.  Such rows add up: the
state after a base and any increments gives the same figures as all rows read
at once.  Distinct counts of a key are exact, since every key value has a row.
An upload thus costs an aggregate of its own rows, and a dashboard reads the
state, which grows with the key combinations and batches and not with the rows.

Each batch is a folder of its own, so adding it again (a replay after a lost
driver) replaces it and counts nothing twice.  ``compacted`` writes all batches
of a state as one batch of a new state.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.functions import exprs as X

#: Keys of the dashboards' state, of the per-user figures and of the uploads' figures.
LOG_KEYS = ("day", "area", "waste_type")
USER_KEYS = ("user_id",)
UPLOAD_KEYS = ("user_id", "area", "waste_type")

_BATCH_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def partials(rows: DataFrame, keys, value: str, date: str | None = None) -> DataFrame:
    """The state rows of ``rows``: keys, n, n_values, total, low, high.
    ``date`` names the column that the key ``day`` is taken from."""
    if date is not None:
        rows = rows.withColumn("day", F.col(date).cast("date"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"),
        F.sum(F.col(value).cast(X.EXACT)).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def merged(state: DataFrame, keys) -> DataFrame:
    """State rows with equal keys added up to one."""
    return state.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def add_batch(rows: DataFrame, path: str, batch: str, keys, value: str, date: str | None = None) -> None:
    """Adds the rows of ``batch`` to the state at ``path``, or replaces them if it was added before."""
    if not _BATCH_NAME.fullmatch(batch):
        raise ValueError(f"batch names are letters, digits, '_', '.' and '-': {batch!r}")
    partials(rows, keys, value, date).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, keys) -> DataFrame:
    """The state at ``path`` over all its batches, one row per combination of keys."""
    return merged(spark.read.parquet(path).drop("batch"), keys)


def compacted(spark: SparkSession, path: str, target: str, keys, batch: str = "base") -> None:
    """Writes the state at ``path`` to ``target`` as one batch; the batches in it must not be added there again."""
    stored(spark, path, keys).write.mode("errorifexists").parquet(f"{target}/batch={batch}")


# ---------------------------------------------------------------- figures from state rows

def _mean() -> Column:
    return (F.sum("total").cast("double") / F.sum("n_values")).alias("avg_weight")


def _count() -> Column:
    return F.sum("n").alias("n")


def _total() -> Column:
    return F.sum("total").cast("double").alias("total_weight")


def overall(state: DataFrame) -> DataFrame:
    """One row with count (0 for an empty state) and mean."""
    return state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _mean())


def top_areas(state: DataFrame, k: int = 10) -> DataFrame:
    """Per area count and mean, the k with most rows (ties by area)."""
    return state.groupBy("area").agg(_count(), _mean()).orderBy(F.desc("n"), F.asc("area")).limit(k)


def by_date(state: DataFrame, k: int = 7) -> DataFrame:
    """Total per day, newest k days."""
    return state.groupBy("day").agg(_total()).orderBy(F.desc("day")).limit(k)


def trend_daily(state: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per day since ``as_of - days``, ascending."""
    lo = F.date_sub(F.lit(as_of).cast("date"), days)
    return state.filter(F.col("day") >= lo).groupBy("day").agg(_count(), _mean(), _total()).orderBy("day")


def trend(state: DataFrame, label: Column, name: str, k: int = 12) -> DataFrame:
    """Per label of the day (a week or month), the newest k labels, oldest first."""
    newest = state.groupBy(label.alias(name)).agg(_count(), _mean(), _total()).orderBy(F.desc(name)).limit(k)
    return newest.orderBy(name)


def trend_weekly(state: DataFrame, k: int = 12) -> DataFrame:
    """D5."""
    return trend(state, X.week_label("day"), "week", k)


def trend_monthly(state: DataFrame, k: int = 12) -> DataFrame:
    """D6."""
    return trend(state, X.month_label("day"), "month", k)


def pattern_day_of_week(state: DataFrame) -> DataFrame:
    """Sunday first."""
    g = state.groupBy(X.weekday_sun0("day").alias("day_num")).agg(_mean(), _count())
    return g.select(X.day_name("day_num").alias("day_name"), "day_num", "avg_weight", "n").orderBy("day_num")


def pattern_month(state: DataFrame) -> DataFrame:
    """D8."""
    g = state.groupBy(F.month("day").cast("int").alias("month_num")).agg(_mean(), _count())
    return g.select(X.month_name("month_num").alias("month_name"), "month_num", "avg_weight", "n").orderBy("month_num")


def area_analysis(state: DataFrame) -> DataFrame:
    """Per area, by total descending."""
    return (state.groupBy("area").agg(_count(), _mean(), F.min("low").alias("min_weight"),
                                      F.max("high").alias("max_weight"), _total())
            .orderBy(F.desc("total_weight"), F.asc("area")))


def summary(state: DataFrame) -> DataFrame:
    """One row; NULL statistics are 0."""
    s = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"), _mean(),
                  F.min("low").alias("min_weight"), F.max("high").alias("max_weight"), _total(),
                  F.count_distinct("area").alias("unique_areas"),
                  F.count_distinct("waste_type").alias("unique_waste_types"))
    return s.select("total_predictions",
                    *[F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c)
                      for c in ("avg_weight", "min_weight", "max_weight", "total_weight")],
                    "unique_areas", "unique_waste_types")


def user_profile(state: DataFrame) -> DataFrame:
    """Count and mean per user."""
    return state.groupBy("user_id").agg(_count(), _mean())


def historical_averages(state: DataFrame) -> DataFrame:
    """Mean by area, by waste type and overall, as (level, key, n, avg_weight)."""
    g = (state.groupingSets([["area"], ["waste_type"], []], "area", "waste_type")
         .agg(F.coalesce(F.sum("n_values"), F.lit(0)).alias("n"), _mean(),
              F.grouping("area").alias("_ga"), F.grouping("waste_type").alias("_gt")))
    level = (F.when(F.col("_ga") == 0, F.lit("area"))
             .when(F.col("_gt") == 0, F.lit("waste_type")).otherwise(F.lit("overall")))
    key = F.when(F.col("_ga") == 0, F.col("area")).when(F.col("_gt") == 0, F.col("waste_type"))
    return g.select(level.alias("level"), key.alias("key"), "n", "avg_weight")


def upload_stats(state: DataFrame, k: int = 5) -> DataFrame:
    """Per user the k areas and the k types with most rows."""
    g = (state.groupingSets([["user_id", "area"], ["user_id", "waste_type"]], "user_id", "area", "waste_type")
         .agg(_count(), _mean(), F.grouping("area").alias("_ga")))
    by_area = F.col("_ga") == 0
    g = g.select("user_id", F.when(by_area, F.lit("area")).otherwise(F.lit("waste_type")).alias("dimension"),
                 F.when(by_area, F.col("area")).otherwise(F.col("waste_type")).alias("key"), "n", "avg_weight")
    w = W.partitionBy("user_id", "dimension").orderBy(F.desc("n"), F.asc("key"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
