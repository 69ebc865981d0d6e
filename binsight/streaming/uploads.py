"""Upload ingest as a Structured Streaming job.

Files dropped into an upload folder are read by the file source, normalised
with the same column expressions as the batch path, and appended: accepted
rows to the fact table, rejected rows (with their reason) to a rejects table.
Progress is kept in a checkpoint folder, so a restarted or failed job
resumes without double-appending (file source + ``foreachBatch`` with batch
ids written idempotently per batch folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binsight.sources import ingest


def upload_stream(spark: SparkSession, in_dir: str, headers: list[str], fmt: str = "csv") -> DataFrame:
    """Streaming frame of uploaded records.

    ``headers`` names the columns of CSV files (file sources need a schema up
    front; every field is a string); a file whose header differs from them
    fails the query instead of being read by position.  JSON Lines files
    (``fmt="json"``) are parsed record by record, whatever their keys.
    """
    if fmt != "csv":
        return ingest.normalize_upload(ingest.json_records(spark.readStream.text(in_dir)))
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    raw = spark.readStream.option("header", True).option("enforceSchema", False).schema(schema).csv(in_dir)
    return ingest.normalize_upload(raw)


def start_ingest(spark: SparkSession, in_dir: str, headers: list[str], table_path: str, rejects_path: str,
                 checkpoint: str, fmt: str = "csv", available_now: bool = False):
    """Start the ingest query.  Each micro-batch is written to a folder named
    by its batch id, so a batch replayed after a failure overwrites its own
    output instead of appending twice."""
    stream = upload_stream(spark, in_dir, headers, fmt)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once, written to two tables
        try:
            good, bad = ingest.split_rejects(batch)
            good.drop("raw_date").write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The appended fact table (all batches)."""
    return spark.read.parquet(table_path).drop("batch").select(
        "area", "waste_type", "date", F.col("weight").cast("double").alias("weight"))
