"""Table changes that rewrite only the partitions they touch.

The table is a folder of Parquet files partitioned by one column.  A change
first finds the partitions that hold a row it alters or receive one, reads
those alone, writes their new rows to a staging table in the shared checkpoint
folder, and overwrites those partitions dynamically from it.  A partition left
without rows is removed.  All other partitions keep their files.

Every change may be applied again after a failure at any point and then gives
the result of one that did not fail: a changed key is replaced wherever it is.
One change runs on a table at a time.  The driver holds the touched partitions'
values, never rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from binsight.operators import changes as C
from binsight.session import scratch_path


def write_table(df: DataFrame, path: str, partition_by: str) -> None:
    """Writes a new partitioned table; AQE splits large partitions over tasks and merges small ones."""
    df.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows.  The schema is given, so that partition values such as '01' stay what they are."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _among(column: str, values: list) -> Column:
    """Whether the column is one of the values, null included; a filter that prunes partitions."""
    some = [v for v in values if v is not None]
    hit = F.col(column).isin(some) if some else F.lit(False)
    return hit | F.col(column).isNull() if len(some) < len(values) else hit


def _values(df: DataFrame, column: str) -> list:
    """Distinct partition values; at most one for each partition."""
    return [r[0] for r in df.select(column).distinct().collect()]


def _remove(table: DataFrame, column: str, values: list) -> None:
    """Removes the folders of the partitions with these values."""
    spark = table.sparkSession
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    folders = table.filter(_among(column, values)).select(folder).distinct().collect()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in folders:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))  # file_path is URI-encoded
        if not target.getFileSystem(conf).delete(target, True):
            raise OSError(f"the emptied partition {row['folder']} could not be removed")


def rewrite(spark: SparkSession, path: str, schema: StructType, partition_by: str, touched: DataFrame,
            change: Callable[[DataFrame], DataFrame]) -> list:
    """Replaces the rows of the touched partitions by ``change`` of them; returns those partitions' values.

    ``touched`` holds, in the column ``partition_by``, every partition that
    ``change`` takes rows from or gives rows to."""
    values = _values(touched, partition_by)
    if not values:
        return []
    raw = spark.read.schema(schema).parquet(path)
    staging = scratch_path(spark, "rewrite")
    changed = change(raw.filter(_among(partition_by, values)).select(*schema.names))
    changed.select(*schema.names).hint("rebalance", partition_by).write.parquet(staging)
    rows = spark.read.schema(schema).parquet(staging)
    filled = set(_values(rows, partition_by))
    if not filled <= set(values):
        raise ValueError("the change gives rows to partitions that are not among the touched ones")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).parquet(path))
    emptied = [v for v in values if v not in filled]
    if emptied:
        _remove(raw, partition_by, emptied)
    return values


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, order_cols: list[str], partition_by: str) -> list:
    """M1: each key of ``new`` has its newest new row (by ``order_cols``, then all columns) in place of its stored ones.

    Rows of other keys stay as they are, those without a key too.  New rows
    without a key are left out.  A key whose new row has another partition value moves."""
    schema = new.schema
    keyed = new.filter(F.col(key).isNotNull())
    others = [c for c in schema.names if c != key]
    order = F.struct(*order_cols, *[F.col(c).cast("string") for c in others])
    latest = keyed.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")
    keys = keyed.select(key).distinct()
    table = read_table(spark, path, schema)
    touched = table.join(keys, key, "left_semi").select(partition_by).unionByName(latest.select(partition_by))
    return rewrite(spark, path, schema, partition_by, touched,
                   lambda rows: rows.join(keys, key, "left_anti").unionByName(latest.select(*schema.names)))


def delete(spark: SparkSession, path: str, schema: StructType, predicate: Column, partition_by: str) -> list:
    """M2: removes the rows that match ``predicate``; a NULL predicate keeps the row."""
    touched = read_table(spark, path, schema).filter(F.coalesce(predicate, F.lit(False))).select(partition_by)
    return rewrite(spark, path, schema, partition_by, touched, lambda rows: C.delete_where(rows, predicate))


def delete_keys(spark: SparkSession, path: str, schema: StructType, deleted: DataFrame, column: str,
                partition_by: str, key: str = "id") -> list:
    """M3: removes the rows whose ``column`` is a key of ``deleted``."""
    gone = deleted.select(F.col(key).alias(column)).distinct()
    touched = read_table(spark, path, schema).join(gone, column, "left_semi").select(partition_by)
    return rewrite(spark, path, schema, partition_by, touched, lambda rows: rows.join(gone, column, "left_anti"))


def update(spark: SparkSession, path: str, schema: StructType, new: DataFrame, key: str, columns: list[str],
           partition_by: str, order_cols: list[str] | None = None) -> list:
    """M4: overwrites ``columns`` from ``new`` where the key matches, NULLs included; rows move to another
    partition if ``partition_by`` is among the columns."""
    table = read_table(spark, path, schema)
    hit = table.join(new.select(key).distinct(), key, "left_semi")
    touched = hit.select(partition_by)
    if partition_by in columns:
        # each key's chosen row only: others give no row to their partitions
        touched = touched.unionByName(C.update_by_key(hit, new, key, columns, order_cols).select(partition_by))
    return rewrite(spark, path, schema, partition_by, touched,
                   lambda rows: C.update_by_key(rows, new, key, columns, order_cols))
