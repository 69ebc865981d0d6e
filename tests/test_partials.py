"""Stored state against the operators on all rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from binsight.operators import partials as P
from binsight.operators import summary as S

ROWS = [(1, dt.date(2024, 1, 1), "North", "Paper", 10.5, 7), (2, dt.date(2024, 1, 1), "North", "Paper", None, 7),
        (3, dt.date(2024, 2, 29), "South", None, -3.25, 8), (4, None, None, "Glass", 4.0, None),
        (5, dt.date(2023, 12, 31), "", "Glass", 0.0, 8), (5, dt.date(2023, 12, 31), "", "Glass", 0.0, 8),
        (6, dt.date(2024, 1, 7), "South", "Paper", 99.99, 9)]
SCHEMA = ("id long, prediction_date date, area string, waste_type string, predicted_weight_kg double, user_id long")


def _log(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def _add(df, path, name, keys=P.LOG_KEYS):
    P.add_batch(df, path, name, keys, "predicted_weight_kg", "prediction_date")


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)


def test_base_and_increments_equal_a_full_run(spark, tmp_path):
    logs, path = _log(spark), str(tmp_path / "state")
    for i in range(3):
        _add(logs.filter(F.col("id") % 3 == i), path, f"b{i}")
    _add(logs.filter("id % 3 = 1"), path, "b1")  # a replay counts nothing twice
    st = P.stored(spark, path, P.LOG_KEYS)
    day = lambda df: df.withColumnRenamed("day", "prediction_date")
    _same(P.overall(st), S.stats_overall(logs))
    _same(P.summary(st), S.summary(logs))
    _same(P.top_areas(st, 2), S.stats_by_area(logs, 2))
    _same(day(P.by_date(st)), S.stats_by_date(logs))
    _same(day(P.trend_daily(st, "2024-01-10")), S.trend_daily(logs, "2024-01-10"))
    _same(P.trend_weekly(st, 2), S.trend_weekly(logs, 2))
    _same(P.trend_monthly(st, 2), S.trend_monthly(logs, 2))
    _same(P.pattern_day_of_week(st), S.pattern_day_of_week(logs))
    _same(P.pattern_month(st), S.pattern_month(logs))
    _same(P.area_analysis(st), S.area_analysis(logs))
    _same(P.historical_averages(st), S.historical_averages(logs, "predicted_weight_kg"))


def test_users_and_uploads(spark, tmp_path):
    logs = _log(spark)
    for name, part in (("a", logs.filter("id < 4")), ("b", logs.filter("id >= 4"))):
        _add(part, str(tmp_path / "u"), name, P.USER_KEYS)
        _add(part, str(tmp_path / "k"), name, P.UPLOAD_KEYS)
    _same(P.user_profile(P.stored(spark, str(tmp_path / "u"), P.USER_KEYS)), S.user_profile(logs))
    _same(P.upload_stats(P.stored(spark, str(tmp_path / "k"), P.UPLOAD_KEYS), 1),
          S.upload_stats(logs, 1, "predicted_weight_kg"))


def test_compacted_state_takes_new_batches(spark, tmp_path):
    logs, old, new = _log(spark), str(tmp_path / "old"), str(tmp_path / "new")
    _add(logs.filter("id < 3"), old, "a")
    _add(logs.filter("id = 3"), old, "b")
    P.compacted(spark, old, new, P.LOG_KEYS)
    _add(logs.filter("id > 3"), new, "c")
    _same(P.summary(P.stored(spark, new, P.LOG_KEYS)), S.summary(logs))


def test_empty_table_and_bad_name(spark, tmp_path):
    empty, path = _log(spark, []), str(tmp_path / "state")
    _add(empty, path, "none")
    st = P.stored(spark, path, P.LOG_KEYS)
    _same(P.summary(st), S.summary(empty))
    _same(P.overall(st), S.stats_overall(empty))
    _same(P.historical_averages(st), S.historical_averages(empty, "predicted_weight_kg"))
    with pytest.raises(ValueError):
        _add(empty, path, "../other")
