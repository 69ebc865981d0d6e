"""The binned interval join against nested loops."""

import datetime as dt
import random

from binsight.operators import compare


def day(n):
    return dt.date(1970, 1, 1) + dt.timedelta(n)


def test_equals_nested_loops(spark):
    rng = random.Random(4)
    rows = [(i, day(rng.randrange(-3000, 9000))) for i in range(400)] + [(900 + i, day(17)) for i in range(200)] + [(5000, None)]
    periods = []
    for i in range(300):
        lo = rng.randrange(-3000, 9000)
        periods.append((i, day(lo), day(lo + rng.choice([0, 1, 3, 4, 15, 16, 64, 255, 256, 1023, 5000, 20000, -1, -40]))))
    periods += [(700, None, day(5)), (701, day(5), None), (702, day(0), day(0)), (703, day(17), day(17))]
    r = spark.createDataFrame(rows, "id long, d date")
    p = spark.createDataFrame(periods, "period long, lo date, hi date")
    joined = compare.interval_join(r, p, "d")
    got = sorted((x["id"], x["period"]) for x in joined.collect())
    want = sorted((i, k) for i, d in rows for k, lo, hi in periods if d and lo and hi and lo <= d <= hi)
    assert got == want and joined.columns == ["id", "d", "period", "lo", "hi"]
    assert compare.interval_join(r, p.limit(0), "d").count() == 0 and compare.interval_join(r.limit(0), p, "d").count() == 0
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_periods(spark):
    logs = spark.range(2000).selectExpr("id", "date_add(date'2020-01-01', int(id % 700)) AS d")
    periods = spark.range(100_000).selectExpr("id AS period", "date_add(date'2020-01-01', int(id % 650)) AS lo",
                                              "date_add(date'2020-01-01', int(id % 650 + id % 9)) AS hi")
    assert compare.interval_join(logs.groupBy("d").count(), periods, "d").count() == sum(1 + i % 9 for i in range(100_000))
