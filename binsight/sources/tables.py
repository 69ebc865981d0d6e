"""Readers for the physical test tables and the logical tables built on them.

The logical tables (observations, prediction logs, users, uploads, upload
rows) are plain projections / joins over the physical tables, so Catalyst
prunes columns and pushes filters all the way into the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.session import widen

PHYSICAL = ("region nation customer supplier part orders lineitem events documents "
            "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widen(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _area_dim(spark, sf_dir) -> DataFrame:
    """customer -> area name (one row per customer)."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("area"))


def observations(spark, sf_dir) -> DataFrame:
    """Historical weights: id, area, waste_type, ticket_date, net_weight_kg."""
    o = read(spark, sf_dir, "orders")
    return (o.join(_area_dim(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("id"), "area",
                    F.col("o_orderpriority").alias("waste_type"),
                    F.col("o_orderdate").cast("date").alias("ticket_date"),
                    F.col("o_totalprice").alias("net_weight_kg")))


def prediction_logs(spark, sf_dir) -> DataFrame:
    """Long-range prediction log (years of history)."""
    o = read(spark, sf_dir, "orders")
    return (o.join(_area_dim(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("id"),
                    F.col("o_orderdate").alias("timestamp"), "area",
                    F.col("o_orderpriority").alias("waste_type"),
                    F.col("o_orderdate").cast("date").alias("prediction_date"),
                    F.col("o_totalprice").alias("predicted_weight_kg"),
                    F.col("o_custkey").alias("user_id")))


def recent_logs(spark, sf_dir) -> DataFrame:
    """30-day prediction log (events)."""
    e = read(spark, sf_dir, "events")
    return (e.join(_area_dim(spark, sf_dir), e.user_id == F.col("c_custkey"))
            .select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "area",
                    F.col("event_type").alias("waste_type"),
                    F.col("ts").cast("date").alias("prediction_date"),
                    F.col("value").alias("predicted_weight_kg"), "user_id"))


def session_logs(spark, sf_dir) -> DataFrame:
    """Log of which every second row comes from a visitor's session, named by the
    order key: most such keys are no user's."""
    return prediction_logs(spark, sf_dir).withColumn(
        "user_id", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("user_id")))


def requests(spark, sf_dir) -> DataFrame:
    """All logged requests; the recent ones have waste types that the history doesn't know."""
    return prediction_logs(spark, sf_dir).unionByName(recent_logs(spark, sf_dir))


def users(spark, sf_dir) -> DataFrame:
    """User dimension."""
    c = read(spark, sf_dir, "customer")
    first_order = (read(spark, sf_dir, "orders").groupBy("o_custkey")
                   .agg(F.min("o_orderdate").alias("created_at")))
    return (c.join(first_order, c.c_custkey == first_order.o_custkey, "left")
            .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
                    F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
                    (F.col("c_mktsegment") == "BUILDING").alias("is_admin"),
                    "created_at"))


def uploads(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                    F.concat(F.lit("file_"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"),
                    F.col("o_orderpriority").alias("file_type"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_orderdate").alias("created_at"))


def upload_rows(spark, sf_dir) -> DataFrame:
    """user_data: one row per uploaded record (no unique id; `line` tie-breaks)."""
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_orderkey").alias("upload_id"),
                    F.col("l_linenumber").alias("line"),
                    F.col("o_custkey").alias("user_id"),
                    F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("area"),
                    F.col("l_returnflag").alias("waste_type"),
                    F.col("l_shipdate").cast("date").alias("date"),
                    F.col("l_quantity").alias("weight")))


def scored_requests(spark, sf_dir) -> DataFrame:
    """Predictions to benchmark: one per lineitem (area, type, predicted value), and
    one per recent log row, whose types have no history (the fallback)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    priced = (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(_area_dim(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
              .select("l_orderkey", "l_linenumber", "area", F.col("o_orderpriority").alias("waste_type"),
                      F.col("l_extendedprice").alias("prediction")))
    recent = recent_logs(spark, sf_dir).select(
        F.col("id").alias("l_orderkey"), F.lit(0).cast(priced.schema["l_linenumber"].dataType).alias("l_linenumber"),
        "area", "waste_type", F.col("predicted_weight_kg").alias("prediction"))
    return priced.unionByName(recent)


def observed(spark, sf_dir) -> DataFrame:
    """Observed weights to hold predictors against: the history, and recent rows of types it doesn't know."""
    recent = recent_logs(spark, sf_dir).select("area", "waste_type", F.col("predicted_weight_kg").alias("net_weight_kg"))
    return observations(spark, sf_dir).select("area", "waste_type", "net_weight_kg").unionByName(recent)


def keyed_snapshots(spark, sf_dir) -> DataFrame:
    """Per-user setting changes: key, value, updated_at, change id."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"),
                    F.col("ts").alias("updated_at"), F.col("event_id").alias("change_id"))
