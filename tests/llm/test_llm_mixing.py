import hashlib
import math

import pytest
from pyspark.sql import functions as F

from binsight.llm import mixing as M


def poisson(rate, doc, seed=M.SEED):
    """Inversion as the contract of the operator words it, in plain Python."""
    draws = max(1, math.ceil(rate / M.STEP))
    total = 0
    for j in range(draws):
        u = int(hashlib.md5(f"{seed}|{j}|{doc}".encode()).hexdigest()[:13], 16) / 2**52
        mean = rate / draws
        p = c = math.exp(-mean)
        k = 0
        while c <= u and k <= M.TOP:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


ROWS = ([(i, "word " * 20, "hot") for i in range(900)] + [(1000 + i, "w" * 200, "b") for i in range(40)] + [(2000, None, None), (2001, "", None),
        (None, "no id", "b"), (3000, "x", "tiny"), (1000, "w" * 200, "b")])


def counts(out):
    found = {}
    for r in out:
        found.setdefault((r.doc_id, r.source), []).append(r.copy_no)
    return found


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "b": 3.0, "absent": 5.0}, {}])
@pytest.mark.parametrize("bound", [20_000, 1])
def test_copies(spark, monkeypatch, weights, bound):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", bound)
    docs = spark.createDataFrame([(*r, "e", 7, 0.5) for r in ROWS],
                                 "doc_id long, text string, source string, lang string, copy_no int, rate double").repartition(4)
    out = M.mixed(docs, weights)
    assert out.columns == ["doc_id", "text", "source", "lang", "rate", "copy_no", "mix_key"]
    size = {}
    for _, t, s in ROWS:
        size[s] = size.get(s, 0) + len(t or "") + 1
    share = {s: 1.0 if weights is None else weights.get(s, 0.0) if s is not None else 0.0 for s in size}
    whole = sum(share.values())
    want = {}
    for i, t, s in ROWS:
        rate = float(sum(size.values())) * share[s] / whole / size[s] if share[s] else 0.0
        n = poisson(rate, "-" if i is None else i)
        if n:
            want.setdefault((i, s), []).extend(range(1, n + 1))
    got = counts(out.collect())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_shares_meet_their_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"),
                                    F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("source"))
    n = {r.source: r["count"] for r in M.mixed(docs, {"hot": 1, "cold": 1}).groupBy("source").count().collect()}
    assert abs(n["hot"] - 3000) < 250 and abs(n["cold"] - 3000) < 250


def test_order_is_global_and_random(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    parts = M.mixed(docs).withColumn("p", F.spark_partition_id()).collect()
    by = {}
    for r in parts:
        by.setdefault(r.p, []).append(r.mix_key)
    assert all(v == sorted(v) for v in by.values())


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixed(docs).collect() == []


def test_main_path_is_native(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert "Python" not in (plan := M.mixed(docs)._jdf.queryExecution().toString()) and "Arrow" not in plan
