"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every binsight job relies on. They are applied to sessions we build;
# `configure()` applies the runtime-settable ones to a session someone else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of whole texts go to Python in batches that fit two workers an executor
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


# Suggested settings for the large-cluster deployment (hundreds of TB, ~1000
# executors).  Applied only when asked (``build_session(cluster=True)``):
# shuffles start wide and AQE coalesces them to ~256 MB partitions, scans
# split files into 256 MB tasks, skewed partitions above 1 GB are split in
# joins, and broadcasts decided at runtime stay under 64 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "binsight", cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session with binsight's settings.

    On a cluster leave ``master`` unset and let spark-submit provide it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", os.environ.get("BINSIGHT_DRIVER_MEMORY", "8g"))
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    if cluster:
        for k, v in CLUSTER_CONF.items():
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # some confs are static on managed clusters
            pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is.  Only
    when it is unset (local runs and tests) a private folder is created.
    """
    jsc = spark.sparkContext._jsc
    current = jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            configured = None
    if not configured:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            # a machine-local folder is not visible to other executors
            raise RuntimeError("spark.checkpoint.dir must name shared storage on a cluster")
        configured = tempfile.mkdtemp(prefix="binsight-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/binsight-scratch/{name}-{uuid.uuid4().hex}"


#: Bytes of a table's files for each partition of a shuffle.
TABLE_BYTES = 4 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Spark's own most bytes that a task scans, or reads of a shuffle where AQE merges partitions, and ours.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": ("134217728b", "16m"),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m")}


def widen(table: DataFrame) -> DataFrame:
    """Lets the session's shuffles begin with enough partitions for ``table``, a scan, and cuts scans small, so that
    a task's rows and memory do not grow with the table.  AQE merges partitions that turn out small.
    Larger numbers of partitions, and sizes that someone has set, stay as they are."""
    spark = table.sparkSession
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // TABLE_BYTES)
    if wanted > int(spark.conf.get(_INITIAL, None) or default_partitions(spark)):
        spark.conf.set(_INITIAL, str(wanted))
        for name, (default, own) in TASK_BYTES.items():
            if spark.conf.get(name) == default:
                spark.conf.set(name, own)
    return table


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
