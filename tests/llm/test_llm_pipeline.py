import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from binsight.llm import pii
from binsight.llm.common import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return " ".join("".join(rng.choice("etaonrishd") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def corpus(n=120):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        t = text(rng, rng.randrange(20, 120))
        if i % 6 == 0:
            t = " ".join(w if k % 5 else "vermin scoundrel" for k, w in enumerate(t.split()))
        if i % 7 == 1:
            t += " write to some.one@mail.example.com or 10.20.30.40 now"
        rows.append((i, t, "en", f"src{i % 3}"))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "src0") for i in range(1, 30)]                        # copies
    rows += [(2000 + i, rows[i][1] + " and more", "en", "src1") for i in range(1, 30) if len(rows[i][1].split()) > 40]
    return [(i, t, g, s, len(t)) for i, t, g, s in rows], labels


@pytest.fixture()
def folder(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {i for i, r in rows.items() if "vermin" in r.text}
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, folder), f"t-{name}")
        assert docs.columns == before.columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "toxicity":
            kept = set(ids)
            assert len(kept & toxic) <= 2 and len(set(rows) - toxic - kept) <= 4 and len(ids) == len(kept)
        elif name == "near_duplicates":
            assert len(ids) == len(set(ids)) and not [i for i in ids if i >= 1000 and i % 1000 in kept]
            assert {i for i in kept if i < 1000} <= set(ids)
            distinct = set(ids)
        elif name == "personal_data":
            assert set(ids) == distinct
            for r in docs.collect():
                old = rows[r.doc_id].text
                assert r.text == old.replace("some.one@mail.example.com", "[EMAIL]").replace("10.20.30.40", "[IP]")
                assert r.n_chars == len(r.text)
        else:
            assert set(ids) <= distinct and docs.count() > 0
    last = C.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_rows_that_are_odd(spark, folder):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "", 0), (None, "no id here at all", "en", "s", 3),
            (None, "No id  here at all", "en", "s", 3), (5, "x" * 200_000, "en", "s", 1), (6, "a b c d e f", "en", "s", 1), (6, "a b c d e f", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], COLUMNS + ", score int, class_id string")
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), f"t-{name}")
        if name == "near_duplicates":
            assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)[-1][0] is None
            assert docs.where("doc_id IS NULL").count() == 1 and docs.where("doc_id = 6").count() == 1
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "class_id"]
    C.STAGES[-1][1](spark, docs, folder).collect()


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, folder), f"t-{name}")
        assert docs.count() == 0


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = C.run(spark, sf).collect()
    sums = {}
    for r in out:
        sums.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in sums.values()) and out
    assert {r.doc_id for r in out} <= {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_found_personal_data_is_gone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = C.without_personal_data(spark, docs, "/root/testdata/sf0.001")
    left = pii.personal(clean).agg(*[F.sum(f"n_{k}") for k in pii.KINDS]).first()
    assert list(left) == [0, 0, 0, 0]


def test_texts_that_share_an_id_stay(spark, folder):
    rng = random.Random(3)
    a, b, c = (text(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, b.upper()), (2, b), (3, c), (3, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    out = [(r.doc_id, r.text.lower()) for r in C.distinct_documents(spark, docs, folder).collect()]
    assert sorted(out) == sorted([(1, a), (1, b), (3, c)])
