"""Sinks: overwrite / append tables, CSV and JSON exports, report rows,
snapshots, domain lists (SURVEY A6-A11, A14).

Writers are distributed (one file per task); nothing is collected to the
driver.  Paths are the caller's; intermediate folders come from
``binsight.session.scratch_path`` (under the shared checkpoint dir).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X

# Export header names (fixed values shown to users of the CSV export).
EXPORT_HEADERS = {
    "prediction_date": "Prediction Date",
    "area": "Area",
    "waste_type": "Waste Type",
    "predicted_weight_kg": "Predicted Weight (kg)",
    "timestamp": "Timestamp",
}
EXPORT_RECENT_LIMIT = 100
REPORT_LIMIT = 50


def export_frame(logs: DataFrame, user_id=None, limit: int | None = EXPORT_RECENT_LIMIT) -> DataFrame:
    """A8 rows: one user's rows (all of them), or the newest ``limit`` rows of
    everyone, newest first, with the export's header names."""
    if user_id is not None:
        df = logs.filter(F.col("user_id") == user_id).orderBy(F.desc("id"))
    else:
        df = logs.orderBy(F.desc("id"))
        if limit is not None:
            df = df.limit(limit)
    return df.select(*[F.col(c).alias(h) for c, h in EXPORT_HEADERS.items()])


def report_frame(logs: DataFrame, user_id=None, limit: int = REPORT_LIMIT) -> DataFrame:
    """A10: newest ``limit`` rows with the weight formatted as '%.2f kg'."""
    df = logs if user_id is None else logs.filter(F.col("user_id") == user_id)
    top = df.orderBy(F.desc("id")).limit(limit)
    return top.select("prediction_date", "area", "waste_type",
                      X.kg_label("predicted_weight_kg").alias("weight"), "timestamp")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A8 sink: header CSV, one file per task (ordering is kept per file)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """JSON Lines rows plus a one-row ``_count`` sidecar; returns the
    sidecar frame ({count}) without collecting the rows.  The count is that of
    the written files, so it agrees with them, and the plan runs once."""
    df.write.mode(mode).json(f"{path}/predictions")
    count = df.sparkSession.read.schema(df.schema).json(f"{path}/predictions").agg(F.count(F.lit(1)).alias("count"))
    count.write.mode(mode).json(f"{path}/_count")
    return count


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Bulk append (never row by row)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def snapshot(df: DataFrame, base_path: str, at: datetime | None = None) -> str:
    """Copy a table to ``base_path/snapshot_ts=YYYYmmdd_HHMMSS``."""
    at = at or datetime.now(timezone.utc)
    path = f"{base_path.rstrip('/')}/snapshot_ts={at.strftime('%Y%m%d_%H%M%S')}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_domains(domains: DataFrame, path: str) -> None:
    """Persist the (domain, value) lists."""
    domains.write.mode("overwrite").partitionBy("domain").parquet(path)
