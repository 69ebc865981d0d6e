"""Scalar expressions against the reference's edge cases (FIXTURES C)."""

import datetime as dt

from pyspark.sql import functions as F

from binsight.functions import exprs as X


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def test_week_label_monday_first(spark):
    days = [(dt.date(1999, 1, 3),), (dt.date(1996, 1, 1),), (dt.date(2024, 12, 31),)]
    got = _one(spark, X.week_label("d"), days, "d date")
    assert got == ["1999-W00", "1996-W01", "2024-W53"]


def test_week_label_matches_python_strftime(spark):
    start = dt.date(1995, 1, 1)
    days = [(start + dt.timedelta(days=i),) for i in range(0, 4000, 3)]
    got = _one(spark, X.week_label("d"), days, "d date")
    assert got == [d.strftime("%Y-W%W") for (d,) in days]


def test_day_numbers(spark):
    d = [(dt.date(2026, 2, 3),)]  # a Tuesday
    assert _one(spark, X.weekday_mon0("d"), d, "d date") == [1]
    assert _one(spark, X.weekday_sun0("d"), d, "d date") == [2]
    assert _one(spark, X.day_name(X.weekday_sun0("d")), d, "d date") == ["Tuesday"]


def test_flexible_dates(spark):
    rows = [("15/01/2026",), ("05/01/2026",), ("2026-01-15",), ("2026-1-5",), ("2026-13-01",), ("",)]
    got = _one(spark, X.parse_date_flexible("s"), rows, "s string")
    assert got == [dt.date(2026, 1, 15), dt.date(2026, 1, 5), dt.date(2026, 1, 15), dt.date(2026, 1, 5), None, None]


def test_pct_change_rules(spark):
    rows = [(0, 5), (0, 0), (4, 5), (5, 4), (3, 4)]
    got = _one(spark, X.pct_change("o", "n"), rows, "o long, n long")
    assert got == [100.0, 0.0, 25.0, -20.0, 33.3]


def test_half_up_rounding_of_means(spark):
    # sums in cents / counts: 1.005 -> 1.01 (HALF_UP on exact values), 2.675 -> 2.68
    rows = [(201, 2), (535, 2), (-201, 2), (10, 3)]
    got = _one(spark, X.round2_avg_from_cents("s", "n"), rows, "s long, n long")
    assert got == [1.01, 2.68, -1.01, 0.03]


def test_sanitize_order(spark):
    rows = [("  te;st<>  ",), ("\tabc\n",), ("x" * 300,), (None,)]
    got = _one(spark, X.sanitize("s"), rows, "s string")
    assert got == ["test", "abc", "x" * 255, None]


def test_sanitize_cap_before_removal(spark):
    # the cap is applied before removing characters, like the reference
    s = "a" * 254 + ";b"
    assert _one(spark, X.sanitize("s"), [(s,)], "s string") == ["a" * 254]


def test_try_double_defaults(spark):
    rows = [("3",), ("abc",), ("",), (None,), ("nan",), ("1e3",)]
    got = _one(spark, X.try_double("s"), rows, "s string")
    assert got == [3.0, 0.0, 0.0, 0.0, 0.0, 1000.0]


def test_clamp_and_display(spark):
    assert _one(spark, X.clamp_non_negative("p"), [(-3.2,), (4.0,)], "p double") == [0.0, 4.0]
    assert _one(spark, X.display_name("u"), [(None,), ("",), ("bob",)], "u string") == ["Anonymous", "Anonymous", "bob"]
    assert _one(spark, X.kg_label("w"), [(12.345,), (3.0,)], "w double") == ["12.35 kg", "3.00 kg"]


def test_exact_avg_null_group(spark):
    df = spark.createDataFrame([("Z", None)], "area string, w double")
    r = df.groupBy("area").agg(F.count(F.lit(1)).alias("n"), X.exact_avg("w").alias("a")).first()
    assert r["n"] == 1 and r["a"] is None
