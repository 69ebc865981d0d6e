"""Hot keys: one date / series / user holding half of the rows."""

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.operators import ordered


def _skewed(spark, n=20000):
    hot = dt.date(2024, 1, 15)
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, F.lit(hot)).otherwise(F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 30).cast("int"))).alias("d"),
        F.when(F.col("id") % 2 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("A"), (F.col("id") % 7).cast("string"))).alias("area"),
        (F.col("id") % 1000 / 10.0).alias("v"))
    return df


def test_hot_date_is_split_across_range_partitions(spark):
    df = _skewed(spark)
    ranged = ordered._ranged(df, ["d", "id"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_pid").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * (20000 / 8)


def test_rank_and_lag_exact_under_skew(spark):
    df = _skewed(spark)
    r = ordered.global_rank(df, ["d", "id"], num_partitions=8)
    ref = df.withColumn("rn2", F.row_number().over(W.orderBy("d", "id")))
    assert r.join(ref.select("id", "rn2"), "id").filter("rn <> rn2").count() == 0
    lag = ordered.lag_global(df, "v", ["d", "id"], series_cols=["area"], num_partitions=8)
    ref2 = df.withColumn("ref", F.lag("v").over(W.partitionBy("area").orderBy("d", "id")))
    assert lag.join(ref2.select("id", "ref"), "id").filter(~F.col("lag_1").eqNullSafe(F.col("ref"))).count() == 0


def test_top_k_for_hot_user(spark):
    df = _skewed(spark).withColumn("user_id", F.when(F.col("area") == "HOT", F.lit(1)).otherwise(F.col("id") % 50 + 2))
    top = ordered.top_k_per_key(df, "user_id", [F.desc("id")], 5)
    hot = [r["id"] for r in top.filter("user_id = 1").orderBy("rn").collect()]
    assert hot == [19998, 19996, 19994, 19992, 19990]


def test_hot_value_is_one_row(spark):
    from binsight.operators import profile
    df = spark.range(20000).select(F.when(F.col("id") % 10 < 9, F.lit(0.0)).otherwise(F.col("id").cast("double")).alias("x"))
    ranked = profile._counted(df, "x")
    assert ranked.count() == 2001 and ranked.orderBy("x").first().n == 18000
    one = profile.describe(df, "x").first()
    assert one["count"] == 20000 and one.q50 == 0.0 and one.max == 19999.0
    import numpy as np
    x = np.where(np.arange(20000) % 10 < 9, 0.0, np.arange(20000))
    assert abs(one.mean - x.mean()) < 1e-9 and abs(one["std"] - x.std(ddof=1)) < 1e-6
    ks = profile.ks_uniform(df, "x").first()
    s = np.sort(x) / x.max()
    d = max((np.arange(1, 20001) / 20000 - s).max(), (s - np.arange(20000) / 20000).max())
    assert abs(ks.d_stat - d) < 1e-12 and ks.p_value == 0.0


def test_scratch_tables_are_dropped(spark):
    from binsight.operators import profile
    tables = lambda: {t.name for t in spark.catalog.listTables(ordered.SCRATCH_DB)}
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"))
    with ordered.scratch(spark):
        assert ordered.global_rank(df, ["x", "id"], num_partitions=4).count() == 500
        before = tables()
        assert profile.describe(df, "x").first()["count"] == 500 and profile.ks_uniform(df, "x").first().n == 500
        assert tables() == before and len(before) >= 1
    assert len(tables()) == len(before) - 1
