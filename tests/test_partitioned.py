"""Changes of partitioned tables: right rows, and no other partition's files touched."""

import os

from pyspark.sql import functions as F

from binsight.operators import partitioned as R

SCHEMA = "id long, part string, v long"
ROWS = [(1, "01", 1), (2, "01", 2), (3, "a/b c", 3), (4, None, 4), (5, "x", 5), (None, "x", 6), (7, "y", 7)]


def _table(spark, tmp_path, rows=ROWS):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(rows, SCHEMA)
    R.write_table(df, path, "part")
    return path, df.schema


def _files(path):
    return {os.path.relpath(os.path.join(a, f), path) for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _folders(path):
    return {f.split("/")[0] for f in _files(path)}


def _rows(spark, path, schema):
    return sorted([tuple(r) for r in R.read_table(spark, path, schema).collect()], key=repr)


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path, schema = _table(spark, tmp_path)
    before = _files(path)
    new = spark.createDataFrame([(2, "01", 20), (2, "01", 21), (8, "new", 8), (None, "y", 9)], schema)
    for _ in range(2):  # again, as after a failure
        assert set(R.upsert(spark, path, new, "id", ["v"], "part")) == {"01", "new"}
        want = [r for r in ROWS if r[0] != 2] + [(2, "01", 21), (8, "new", 8)]
        assert _rows(spark, path, schema) == sorted(want, key=repr)
    kept = {f for f in before if not f.startswith("part=01/")}
    assert kept <= _files(path)


def test_rows_move_and_emptied_partitions_go(spark, tmp_path):
    path, schema = _table(spark, tmp_path)
    new = spark.createDataFrame([(3, None, 30), (4, "01", 40)], schema)
    assert set(R.upsert(spark, path, new, "id", ["v"], "part")) == {"01", "a/b c", None}
    assert _rows(spark, path, schema) == sorted(
        [r for r in ROWS if r[0] not in (3, 4)] + [(3, None, 30), (4, "01", 40)], key=repr)
    assert "part=a%2Fb c" not in _folders(path) and len(_folders(path)) == 4


def test_a_half_done_move_is_completed(spark, tmp_path):
    """As if the driver had died after the new partition was written and before the old one was removed."""
    path, schema = _table(spark, tmp_path, [*ROWS, (7, "z", 70)])
    R.upsert(spark, path, spark.createDataFrame([(7, "z", 70)], schema), "id", ["v"], "part")
    assert _rows(spark, path, schema) == sorted([r for r in ROWS if r[0] != 7] + [(7, "z", 70)], key=repr)


def test_delete(spark, tmp_path):
    path, schema = _table(spark, tmp_path)
    before = _files(path)
    assert set(R.delete(spark, path, schema, F.col("v").isin(2, 3, 4), "part")) == {"01", "a/b c", None}
    assert _rows(spark, path, schema) == sorted([r for r in ROWS if r[2] not in (2, 3, 4)], key=repr)
    assert _folders(path) == {"part=01", "part=x", "part=y"}
    assert {f for f in before if f.startswith(("part=x/", "part=y/"))} <= _files(path)
    files = _files(path)
    assert R.delete(spark, path, schema, F.col("v") == 99, "part") == [] and _files(path) == files
    # rows whose predicate is NULL stay; then the last rows go
    assert set(R.delete(spark, path, schema, F.col("id") > 0, "part")) == {"01", "x", "y"}
    assert _rows(spark, path, schema) == [(None, "x", 6)]
    R.delete(spark, path, schema, F.lit(True), "part")
    assert _rows(spark, path, schema) == []


def test_delete_keys(spark, tmp_path):
    path, schema = _table(spark, tmp_path)
    gone = spark.createDataFrame([(1,), (1,), (7,), (None,)], "id long")
    assert set(R.delete_keys(spark, path, schema, gone, "id", "part")) == {"01", "y"}
    assert _rows(spark, path, schema) == sorted([r for r in ROWS if r[0] not in (1, 7)], key=repr)


def test_update_moves_rows(spark, tmp_path):
    path, schema = _table(spark, tmp_path)
    before = _files(path)
    new = spark.createDataFrame([(1, "y", 10), (1, "q", 9), (99, "w", 0)], schema)
    assert set(R.update(spark, path, schema, new, "id", ["part", "v"], "part", ["v"])) == {"01", "y"}
    assert _rows(spark, path, schema) == sorted([r for r in ROWS if r[0] != 1] + [(1, "y", 10)], key=repr)
    assert R.update(spark, path, schema, new.select("id", "v"), "id", ["v"], "part", ["v"]) == ["y"]
    assert {f for f in before if not f.startswith(("part=01/", "part=y/"))} <= _files(path)
