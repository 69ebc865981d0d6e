"""The exact-size split: size, layout independence, repeated and null keys."""

import math

import pytest

from binsight.models import train


@pytest.mark.parametrize("n,pct", [(0, 20), (1, 20), (4, 20), (5, 20), (6, 20), (1000, 20), (777, 33), (10, 0), (10, 100)])
def test_size(spark, n, pct):
    df = train.exact_split(spark.range(n), "id", pct)
    assert df.where("is_test").count() == math.ceil(n * pct / 100) and df.count() == n


def test_same_rows_in_any_layout(spark):
    base = spark.range(5000)
    some = [sorted(r[0] for r in train.exact_split(x, "id").where("is_test").collect()) for x in (base.coalesce(1), base.repartition(7), base.orderBy("id"))]
    assert some[0] == some[1] == some[2] and len(some[0]) == 1000
    assert sorted(r[0] for r in train.exact_split(base, "id", seed=1).where("is_test").collect()) != some[0]


def test_rows_of_a_key_stay_together(spark):
    rows = [(None,)] * 30 + [(i % 50,) for i in range(500)]
    df = train.exact_split(spark.createDataFrame(rows, "id long"), "id")
    sides = df.groupBy("id").agg(train.F.countDistinct("is_test").alias("sides")).collect()
    assert all(r["sides"] == 1 for r in sides)
    taken = df.where("is_test").count()
    assert 106 <= taken < 106 + 30


def test_rows_are_made_once(spark):
    """The passes read the stored hashes: the rows' plan runs once however many passes there are."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(0, 1000, 1, 2).mapInArrow(count, "id long")
    out = train.exact_split(df, "id", 33)
    assert made.value == 1000
    assert out.where("is_test").count() == 330
