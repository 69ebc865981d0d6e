"""Order-dependent operators without a single-partition sort.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
Instead the rows are range-partitioned on the order key (Spark samples the key
to choose balanced boundaries, so a hot date is split across tasks), sorted
within each partition, written once as a table bucketed by range (one bucket
per range, so later windows and aggregates per range need no shuffle), and
stitched together with a per-partition table whose size is the number of
partitions:

* global rank  = rows before this partition + position inside it
* lag          = previous row inside the partition, or the last row of the
                 previous non-empty partition for a partition's first row
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.session import default_partitions, ensure_checkpoint_dir, scratch_path

_PID = "_pid"
SCRATCH_DB = "binsight_scratch"


def _bucket_keys(spark, n: int) -> DataFrame:
    """One bucket key per range partition such that ``pmod(hash(key), n)``
    (Spark's bucket id) equals the partition id: every range gets its own
    bucket.  n rows, computed from ``range(64 n)``."""
    keys = (spark.range(0, 64 * n).select(F.col("id").alias("_bkey"),
                                          F.pmod(F.hash("id"), F.lit(n)).alias(_PID))
            .groupBy(_PID).agg(F.min("_bkey").alias("_bkey")))
    return keys


def _ranged(df: DataFrame, order_cols: list[str], num_partitions: int | None) -> DataFrame:
    """Range-partition + sort, tag each row with its partition id and position,
    and write the result as a table bucketed by partition under the shared
    checkpoint folder.

    The rows and the per-partition tables below must come from the same
    partitions; re-running the range shuffle could sample different
    boundaries (after a lost executor, or a different join choice upstream),
    so the partitioning is materialised once.  Because the table is bucketed
    with one bucket per range, windows and aggregates by partition read it
    without another shuffle.
    """
    spark = df.sparkSession
    n = num_partitions or default_partitions(spark)
    tagged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn(_PID, F.spark_partition_id())
              # (partition id << 33) + row index, evaluated after the in-partition sort
              .withColumn("_pos", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    tagged = tagged.join(F.broadcast(_bucket_keys(spark, n)), _PID, "left")  # n rows
    tagged = tagged.withColumn("_bkey", F.coalesce(F.col("_bkey"), F.col(_PID).cast("long")))
    path = scratch_path(spark, "ranged")
    try:
        # a dedicated scratch database under the checkpoint folder keeps these
        # temporary tables out of user databases; drop it to clean up
        base = ensure_checkpoint_dir(spark).rstrip("/")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH_DB} LOCATION '{base}/binsight-scratch/db'")
        name = f"{SCRATCH_DB}.t_" + uuid.uuid4().hex
        (tagged.write.bucketBy(n, "_bkey").sortBy(_PID, "_pos")
         .option("path", path).saveAsTable(name))
        _created.append((name, path))
        return spark.table(name)
    except AnalysisException:  # no usable session catalog: same result, one more shuffle later
        ensure_checkpoint_dir(spark)
        return tagged.checkpoint(eager=True)


# Scratch tables that this process has made and not dropped: (name, path).
_created: list[tuple[str, str]] = []


@contextlib.contextmanager
def scratch(spark):
    """Drops the scratch tables that ordered operators make inside the block, files
    included.  Read or write their results before the block ends."""
    before = len(_created)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for name, path in _created[before:]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        del _created[before:]


def _rank_parts(df: DataFrame, order_cols: list[str], rank_col: str, num_partitions: int | None):
    """(ranked rows, one-row total count) from the same range partitions."""
    ranged = _ranged(df, order_cols, num_partitions)
    counts = ranged.groupBy("_bkey", _PID).agg(F.count(F.lit(1)).alias("_cnt")).drop("_bkey")
    # one row per range partition: the running sum over this tiny table runs in
    # one task (explicit constant partition)
    offsets = counts.select(_PID, F.coalesce(F.sum("_cnt").over(
        W.partitionBy(F.lit(0)).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = (ranged.join(F.broadcast(offsets), _PID)
              .withColumn(rank_col, F.col("_off") + F.col("_pos") + 1)
              .drop(_PID, "_pos", "_off", "_bkey"))
    total = counts.agg(F.coalesce(F.sum("_cnt"), F.lit(0)).alias("_n"))
    return ranked, total


def global_rank(df: DataFrame, order_cols: list[str], rank_col: str = "rn",
                num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number over the whole table in ``order_cols`` order
    (the order key must be unique for a deterministic result)."""
    return _rank_parts(df, order_cols, rank_col, num_partitions)[0]


def value_ranks(values: DataFrame, value: str, count: str = "n", num_partitions: int | None = None) -> DataFrame:
    """Distinct values with counts -> with rank_lo and rank_hi, the first and last
    rank of their rows over the whole table.  However many rows share a value,
    it is one row here."""
    ranged = _ranged(values, [value], num_partitions)
    sums = ranged.groupBy("_bkey", _PID).agg(F.sum(count).alias("_cnt")).drop("_bkey")
    offsets = sums.select(_PID, F.coalesce(F.sum("_cnt").over(
        W.partitionBy(F.lit(0)).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # a row a range
    upto = F.sum(count).over(W.partitionBy("_bkey", _PID).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (ranged.withColumn("_upto", upto).join(F.broadcast(offsets), _PID)
            .withColumn("rank_hi", F.col("_off") + F.col("_upto")).withColumn("rank_lo", F.col("rank_hi") - F.col(count) + 1)
            .drop(_PID, "_pos", "_off", "_upto", "_bkey"))


def lag_global(df: DataFrame, value: str, order_cols: list[str], out_col: str = "lag_1",
               series_cols: list[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Previous row's ``value`` in ``order_cols`` order, over the whole table
    or within each series (``series_cols``) when given."""
    series_cols = series_cols or []
    keys = series_cols + order_cols
    ranged = _ranged(df, keys, num_partitions)
    w = W.partitionBy("_bkey", _PID).orderBy("_pos")
    rows = ranged.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    if series_cols:
        s = F.struct(*series_cols)
        rows = rows.withColumn("_lag_ser", F.lag(s).over(w)).withColumn("_ser", s)
    last = ranged.groupBy("_bkey", _PID).agg(F.max_by(F.struct(F.col(value).alias("v"),
                                                      F.struct(*series_cols).alias("s") if series_cols
                                                      else F.lit(None).alias("s")),
                                             F.struct(*keys)).alias("_last"))
    prev = last.select(_PID, F.lag("_last").over(W.partitionBy(F.lit(0)).orderBy(_PID)).alias("_prev"))  # n rows
    j = rows.join(F.broadcast(prev), _PID, "left")
    if series_cols:
        same_in = F.col("_lag_ser") == F.col("_ser")
        same_prev = F.col("_prev.s") == F.col("_ser")
        lag = F.when(F.col("_first"), F.when(same_prev, F.col("_prev.v"))).otherwise(
            F.when(same_in, F.col("_lag")))
    else:
        lag = F.when(F.col("_first"), F.col("_prev.v")).otherwise(F.col("_lag"))
    return j.withColumn(out_col, lag).drop(_PID, "_pos", "_bkey", "_lag", "_first", "_prev", "_lag_ser", "_ser")


def temporal_split(df: DataFrame, order_cols: list[str], test_size: float = 0.2,
                   num_partitions: int | None = None) -> DataFrame:
    """``train_test_split(shuffle=False)``: the last ceil(test_size * n) rows
    in order are the test set.  Adds ``rn`` and ``split`` ('train'/'test')."""
    ranked, n = _rank_parts(df, order_cols, "rn", num_partitions)  # n: from per-partition counts
    cut = n.select((F.col("_n") - F.ceil(F.col("_n") * F.lit(test_size))).alias("_cut"))
    return (ranked.crossJoin(F.broadcast(cut))  # one row
            .withColumn("split", F.when(F.col("rn") > F.col("_cut"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_cut"))


def top_k_per_key(df: DataFrame, key: str | list[str], order: list, k: int, rank_col: str = "rn") -> DataFrame:
    """The first k rows of each key.  ``row_number() <= k`` lets Spark put a
    partial WindowGroupLimit before the shuffle, so a hot key sends at most k
    rows per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """E5: newest row of each key by ``order_col`` via max_by (partial
    aggregation, no per-key sort)."""
    others = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return g.select(key, "_r.*")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """global top-k (TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def head_tail(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """first and last n rows by ``order_col`` with a ``part`` label."""
    head = df.orderBy(F.asc(order_col)).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.desc(order_col)).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
