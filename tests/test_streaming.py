"""Structured Streaming upload ingest: restart with the same checkpoint does
not duplicate rows; new files are picked up once."""

import os
import tempfile

from binsight.streaming import uploads


def _csv(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write("location,waste,DATE,amount\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_restart_is_idempotent_and_picks_up_new_files(spark):
    base = tempfile.mkdtemp(prefix="binsight-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _csv(src, "a.csv", [("A", "x", "2026-01-01", "1"), ("B", "y", "15/01/2026", "2"), ("", "y", "2026-01-01", "3")])
    headers = ["location", "waste", "DATE", "amount"]
    table, rejects, ckpt = (os.path.join(base, p) for p in ("table", "rejects", "ckpt"))
    uploads.start_ingest(spark, src, headers, table, rejects, ckpt, available_now=True).awaitTermination()
    assert uploads.ingested(spark, table).count() == 2
    assert spark.read.parquet(rejects).count() == 1
    # restart on the same checkpoint: nothing new, nothing duplicated
    uploads.start_ingest(spark, src, headers, table, rejects, ckpt, available_now=True).awaitTermination()
    assert uploads.ingested(spark, table).count() == 2
    _csv(src, "b.csv", [("C", "z", "2026-02-01", "4")])
    uploads.start_ingest(spark, src, headers, table, rejects, ckpt, available_now=True).awaitTermination()
    got = sorted(r["area"] for r in uploads.ingested(spark, table).collect())
    assert got == ["A", "B", "C"]


def test_json_stream_takes_the_number_zero_as_missing(spark):
    base = tempfile.mkdtemp(prefix="binsight-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write('{"area":"A","type":"x","date":"2026-01-01","weight":0,"kg":7}\n')
    table, rejects, ckpt = (os.path.join(base, p) for p in ("table", "rejects", "ckpt"))
    uploads.start_ingest(spark, src, [], table, rejects, ckpt, fmt="json", available_now=True).awaitTermination()
    assert [r.weight for r in uploads.ingested(spark, table).collect()] == [7.0]
