"""Operator semantics and property checks."""

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.operators import changes, compare, joins, ordered, profile, summary
from binsight.sources import tables as T

from conftest import SF_SMALL


def _logs(spark, rows):
    return spark.createDataFrame(rows, "id long, area string, waste_type string, prediction_date date, "
                                       "predicted_weight_kg double, user_id long")


def test_boundary_day_in_both_periods(spark):
    d = dt.date(2024, 1, 10)
    logs = _logs(spark, [(1, "A", "x", d, 10.0, 1), (2, "A", "x", d - dt.timedelta(days=3), 20.0, 1)])
    r = compare.compare_periods(logs, ("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20")).first()
    assert r["p1_count"] == 2 and r["p2_count"] == 1
    assert r["p1_avg"] == 15.0 and r["p2_total"] == 10.0
    assert r["count_change"] == -50.0 and r["avg_diff"] == -5.0


def test_empty_period_gives_no_change(spark):
    logs = _logs(spark, [(1, "A", "x", dt.date(2024, 1, 5), 10.0, 1)])
    r = compare.compare_periods(logs, ("2024-01-01", "2024-01-10"), ("2025-01-01", "2025-01-10")).first()
    assert r["p1_count"] == 1 and r["p2_count"] is None and r["count_change"] is None


def test_equal_periods_zero_change(spark):
    logs = T.prediction_logs(spark, SF_SMALL)
    r = compare.compare_periods(logs, ("1996-01-01", "1996-12-31"), ("1996-01-01", "1996-12-31")).first()
    assert r["count_change"] == 0.0 and r["total_change"] == 0.0 and r["avg_diff"] == 0.0


def test_quick_compare_zeros_and_boundary(spark):
    as_of = dt.date(2024, 1, 30)
    logs = _logs(spark, [(1, "A", "x", as_of - dt.timedelta(days=7), 5.0, 1)])
    rows = {r["period"]: r for r in compare.quick_compare(logs, as_of).collect()}
    assert rows["week"]["current_count"] == 1 and rows["week"]["previous_count"] == 1
    assert rows["year"]["previous_count"] == 0 and rows["year"]["previous_avg"] == 0.0
    assert rows["week"]["count_change"] == 0.0


def test_trend_counts_sum_to_total(spark):
    logs = T.prediction_logs(spark, SF_SMALL)
    per_month = logs.groupBy(F.date_format("prediction_date", "yyyy-MM")).count().agg(F.sum("count")).first()[0]
    assert per_month == logs.count()


def test_global_rank_equals_row_number(spark):
    obs = T.observations(spark, SF_SMALL).select("id", "ticket_date")
    ours = ordered.global_rank(obs, ["ticket_date", "id"], num_partitions=5)
    ref = obs.withColumn("rn2", F.row_number().over(W.orderBy("ticket_date", "id")))
    j = ours.join(ref, ["id", "ticket_date"])
    assert j.count() == obs.count() and j.filter("rn <> rn2").count() == 0


def test_lag_equals_window_lag(spark):
    obs = T.observations(spark, SF_SMALL).select("id", "area", "waste_type", "ticket_date", "net_weight_kg")
    ours = ordered.lag_global(obs, "net_weight_kg", ["ticket_date", "id"], num_partitions=7)
    ref = obs.withColumn("ref", F.lag("net_weight_kg").over(W.orderBy("ticket_date", "id")))
    assert ours.join(ref, "id").filter(~F.col("lag_1").eqNullSafe(F.col("ref"))).count() == 0
    ser = ordered.lag_global(obs, "net_weight_kg", ["ticket_date", "id"], series_cols=["area", "waste_type"],
                             num_partitions=7)
    ref2 = obs.withColumn("ref", F.lag("net_weight_kg").over(
        W.partitionBy("area", "waste_type").orderBy("ticket_date", "id")))
    assert ser.join(ref2, "id").filter(~F.col("lag_1").eqNullSafe(F.col("ref"))).count() == 0


def test_temporal_split_sizes(spark):
    obs = T.observations(spark, SF_SMALL).select("id", "ticket_date")
    s = ordered.temporal_split(obs, ["ticket_date", "id"])
    n = obs.count()
    import math
    assert s.filter("split = 'test'").count() == math.ceil(0.2 * n)
    last_train = s.filter("split = 'train'").agg(F.max("rn")).first()[0]
    assert last_train == n - math.ceil(0.2 * n)


def test_describe_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    r = profile.describe(df, "x").first()
    assert r["q25"] == 1.75 and r["q50"] == 3.0 and r["q75"] == 5.5 and r["count"] == 4


def test_ks_constant_column_is_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert profile.ks_uniform(df, "x").first()["d_stat"] is None


def test_ks_matches_bruteforce(spark):
    import numpy as np
    vals = [float(v) for v in np.random.default_rng(1).gamma(2.0, 3.0, 500).round(2)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    x = np.sort(np.array(vals))
    u = (x - x.min()) / (x.max() - x.min())
    n = len(x)
    i = np.arange(1, n + 1)
    d = max((i / n - u).max(), (u - (i - 1) / n).max())
    assert abs(profile.ks_uniform(df, "x").first()["d_stat"] - d) < 1e-12


def test_upsert_idempotent_and_newest_wins(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "key long, value string, ts long")
    ch = spark.createDataFrame([(1, "c", 2), (3, "d", 2)], "key long, value string, ts long")
    once = changes.upsert_latest(base, ch, "key", ["ts"])
    twice = changes.upsert_latest(once, ch, "key", ["ts"])
    assert sorted(map(tuple, once.collect())) == [(1, "c", 2), (2, "b", 1), (3, "d", 2)]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_delete_where_keeps_null_predicate(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, t string")
    kept = changes.delete_where(df, F.col("t") == "x")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]


def test_semi_plus_anti_is_all(spark):
    logs = T.requests(spark, SF_SMALL)
    hist = T.observations(spark, SF_SMALL)
    ok = joins.valid_domain_rows(logs, hist).count()
    bad = joins.invalid_domain_rows(logs, hist).count()
    assert ok + bad == logs.count() and bad > 0


def test_benchmark_fallbacks(spark):
    hist = spark.createDataFrame([(1, "A", "x", dt.date(2024, 1, 1), 10.0), (2, "B", "y", dt.date(2024, 1, 1), 0.0)],
                                 "id long, area string, waste_type string, ticket_date date, net_weight_kg double")
    req = spark.createDataFrame([("A", "x", 7.0), ("B", "y", 8.0), ("Q", "z", 9.0)],
                                "area string, waste_type string, prediction double")
    r = {x["area"]: x for x in joins.benchmark_against_history(req, hist).collect()}
    assert r["A"]["area_avg"] == 10.0 and r["A"]["overall_avg"] == 5.0
    assert r["B"]["area_avg"] == 8.0  # mean 0.0 falls back to the prediction
    assert r["Q"]["area_avg"] == 9.0 and r["Q"]["type_avg"] == 9.0


def test_upload_stats_top5_per_user(spark):
    rows = T.upload_rows(spark, SF_SMALL)
    s = summary.upload_stats(rows)
    assert s.groupBy("user_id", "dimension").count().agg(F.max("count")).first()[0] <= 5


def test_csv_export_roundtrip(spark):
    import tempfile

    from binsight.sources import sinks
    logs = T.prediction_logs(spark, SF_SMALL)
    rows = sinks.export_frame(logs, user_id=None)
    path = tempfile.mkdtemp(prefix="binsight-export-") + "/out"
    sinks.write_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["Prediction Date", "Area", "Waste Type", "Predicted Weight (kg)", "Timestamp"]
    assert back.count() == 100


def test_kolmogorov_pvalue_known_values():
    # asymptotic Kolmogorov survival function: Q(1.0) = 0.26999967, Q(1.36) ~ 0.0494
    assert abs(profile.kolmogorov_pvalue(1.0 / 10.0, 100) - 0.2699996716735) < 1e-9
    assert abs(profile.kolmogorov_pvalue(1.36 / 20.0, 400) - 0.04939) < 1e-4
    assert profile.kolmogorov_pvalue(0.0, 10) == 1.0


def test_scale_options_agree(spark):
    logs = T.prediction_logs(spark, SF_SMALL)
    exact = summary.summary(logs).first()
    approx = summary.summary(logs, approx_distinct=True).first()
    assert exact["unique_areas"] == approx["unique_areas"] == 25
    obs = T.observations(spark, SF_SMALL)
    a = profile.describe(obs, "net_weight_kg").first()
    b = profile.describe(obs, "net_weight_kg", exact_quantiles=False).first()
    assert abs(a["q50"] - b["q50"]) <= 0.02 * a["q50"]


def test_legacy_leaderboard_json(spark):
    import json
    import tempfile

    from binsight.models import score as S
    doc = {"random_forest": {"name": "Random Forest", "description": "d", "color": "#27ae60",
                             "mae": 4737.85, "rmse": 9224.56, "r2": 0.9764, "path": "p"},
           "ridge": {"name": "Ridge Regression", "description": "d", "color": "#e74c3c",
                     "mae": 36409.51, "rmse": 45370.77, "r2": 0.4297, "path": "p"}}
    p = tempfile.mkdtemp(prefix="binsight-lb-") + "/model_results.json"
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    lb = S.read_leaderboard(spark, p, legacy=True)
    rows = {r["model_id"]: r for r in lb.collect()}
    assert set(rows) == {"random_forest", "ridge"} and rows["ridge"]["mae"] == 36409.51
    assert [r["model_id"] for r in S.leaderboard(lb).collect()] == ["random_forest", "ridge"]
    missing = S.read_leaderboard(spark, p + ".missing")
    assert missing.count() == 1


def test_averages_leave_null_values_out(spark):
    from binsight.operators import compare
    logs = spark.createDataFrame([("a", "t", "2024-01-10", 4.0), ("a", "t", "2024-01-10", None)],
                                 "area string, waste_type string, prediction_date string, predicted_weight_kg double")
    logs = logs.withColumn("prediction_date", F.col("prediction_date").cast("date"))
    one = compare.compare_periods(logs, ("2024-01-01", "2024-01-31"), ("2024-01-01", "2024-01-31")).first()
    assert one.p1_count == 2 and one.p1_avg == 4.0 and one.p1_total == 4.0
    quick = compare.quick_compare(logs, "2024-01-12").where("period = 'week'").first()
    assert quick.current_count == 2 and quick.current_avg == 4.0


def test_kolmogorov_pvalue_of_small_statistics():
    assert profile.kolmogorov_pvalue(0.0005, 100) == 1.0 and profile.kolmogorov_pvalue(0.001, 100) == 1.0
    # both series agree where they meet
    import math
    for t in (1.17999, 1.18001):
        slow = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 200))
        assert abs(profile.kolmogorov_pvalue(t / 100, 10_000) - slow) < 1e-12


def test_table_changes_have_a_defined_winner(spark):
    base = spark.createDataFrame([("k", 1, "new"), ("m", 5, "m")], "key string, ts int, v string")
    ch = spark.createDataFrame([("k", 0, "older but changed"), ("m", 3, "a"), ("m", 3, "b")], "key string, ts int, v string")
    got = {r.key: r.v for r in changes.upsert_latest(base, ch, "key", ["ts"]).collect()}
    assert got == {"k": "older but changed", "m": "b"}
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, s string, n int")
    up = spark.createDataFrame([(1, "p", 7), (1, "q", None)], "id int, s string, n int")
    got = sorted(tuple(r) for r in changes.update_by_key(rows, up, "id", ["s", "n"]).collect())
    assert got == [(1, "q", None), (2, "y", 6)]


def test_shuffles_begin_with_more_partitions_for_a_larger_table(spark, tmp_path, monkeypatch):
    """Before, their number was the session's whatever the table, and a task's memory grew with the rows."""
    from binsight import session
    from binsight.sources import tables
    spark.range(50_000).repartition(1).write.parquet(str(tmp_path / "orders.parquet"))
    names = [session._INITIAL, *session.TASK_BYTES]
    was = {n: spark.conf.get(n, None) for n in names}
    small, large = 1 << 40, 4 << 10
    try:
        monkeypatch.setattr(session, "TABLE_BYTES", small)
        assert tables.read(spark, str(tmp_path), "orders").count() == 50_000
        assert {n: spark.conf.get(n, None) for n in names} == was
        monkeypatch.setattr(session, "TABLE_BYTES", large)
        df = tables.read(spark, str(tmp_path), "orders")
        assert int(spark.conf.get(session._INITIAL)) > session.default_partitions(spark)
        assert df.groupBy("id").count().count() == 50_000
        wanted = spark.conf.get(session._INITIAL)
        monkeypatch.setattr(session, "TABLE_BYTES", small)
        tables.read(spark, str(tmp_path), "orders")
        assert spark.conf.get(session._INITIAL) == wanted  # a small table read later takes nothing back
    finally:
        for n, v in was.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
