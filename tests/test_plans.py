"""Physical-plan assertions: pushdown, no single-partition row sorts, partial top-k."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from binsight.operators import ordered
from binsight.sources import tables as T

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_trend_daily_pushes_date_filter(spark):
    p = _plan(E.queries()["trend_daily"](spark, SF_SMALL))
    assert "PushedFilters" in p and "ts" in p


def test_scan_prunes_columns(spark):
    df = E.queries()["stats_by_area"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in p  # unused columns are not read


def test_rank_has_no_single_partition_row_sort(spark):
    obs = T.observations(spark, SF_SMALL).select("id", "ticket_date")
    r = ordered.global_rank(obs, ["ticket_date", "id"])
    p = r._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step is the per-partition offsets table
    assert p.count("SinglePartition") <= 1


def test_topk_per_user_uses_partial_group_limit(spark):
    logs = T.prediction_logs(spark, SF_SMALL)
    t = ordered.top_k_per_key(logs, "user_id", [F.desc("id")], 50)
    t.collect()
    assert "WindowGroupLimit" in t._jdf.queryExecution().executedPlan().toString()


def test_recent_rows_is_take_ordered(spark):
    p = E.queries()["recent_rows"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p


def test_flagship_broadcasts_means_not_the_facts(spark):
    df = E.queries()["score_benchmark"](spark, SF_SMALL)
    import re
    p = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    # the mean lookups are broadcast hash joins, so the fact side is not shuffled for them
    assert "BroadcastHashJoin [area], [_area]" in p
    assert "BroadcastHashJoin [waste_type], [_waste_type]" in p
    assert "SortMergeJoin [area]" not in p and "SortMergeJoin [waste_type]" not in p


def test_flagship_beyond_broadcast_bound_uses_shuffle_join(spark, monkeypatch):
    import re

    from binsight.operators import joins
    req = T.scored_requests(spark, SF_SMALL)
    hist = T.observations(spark, SF_SMALL)
    small = joins.benchmark_against_history(req, hist)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = joins.benchmark_against_history(req, hist)
        plan = re.sub(r"#\d+L?", "", big._jdf.queryExecution().executedPlan().toString())
        assert "SortMergeJoin [area], [_area]" in plan
        key = ["l_orderkey", "l_linenumber", "area", "waste_type", "prediction", "area_avg", "type_avg", "overall_avg"]
        assert small.select(*key).exceptAll(big.select(*key)).count() == 0
        assert big.count() == small.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
