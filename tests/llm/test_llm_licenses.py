import re
import time

import duckdb
import pandas as pd
import pytest

from binsight.llm import licenses as L
from binsight.llm.common import table
from conftest import SF_SMALL

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    words = words_of(text)
    at = [(i, label) for i in range(len(words)) for p, label in L.BASE.items() if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), sorted({x for _, x in at}))


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def scanned(docs):
    return {r["doc_id"]: r for r in L.licenses(docs).collect()}


def test_base_equals_brute_force(spark):
    texts = ["CC-BY", "cc by", "x cc\nby-nc 4.0. cc by", "GENERAL Public  License", "all rights reserved all rights reserved.",
             "ccby all rights", "éall rights reserved", "all rights reserved cc", "cc cc by by", "", None, "   ", "general public  license",
             "a\u0085b cc by", "\x00all_rights*reserved\x7fgeneral public license", "KELVIN K cc by", "général public license cc by"]
    got = scanned(frame(spark, *texts))
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text), text


def test_documents_base_equals_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = scanned(docs)
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute_base(r["text"])


def test_every_template_is_found_and_needs_its_phrases(spark):
    texts = [t for _, t, _ in L.TEMPLATES]
    whole = [f"Intro words here. {t.upper()}! And more" for t in texts]
    broken = [" ".join(w if i % 2 else "zzz" for i, w in enumerate(t.split())) for t in texts]
    apart = [t.replace(" ", " zz ") for t in texts]
    got = scanned(frame(spark, *whole, *broken, *apart, "plain prose of the day"))
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in got[i]["labels"] and got[i]["score"] == 1.0
        assert 3 in [p["start"] for p in got[i]["places"] if p["template"] == i]
    for i in range(len(texts), 3 * len(texts) + 1):
        assert not got[i]["places"]


def test_score_of_a_place_without_its_phrase(spark):
    docs = frame(spark, "mozilla public license version 2 0", *["public"] * 9, "mozilla x license version 2 0")
    words = docs.select(L.words_of(L.F.col("text")).alias("words"))
    vocabulary = sorted({w for _, t, _ in L.TEMPLATES for w in t.split()})
    frequency = L.document_frequency(words, vocabulary)
    assert frequency["public"] == 10 and frequency["mozilla"] == 2 and frequency["gnu"] == 0
    assert "public" not in [w for w, t, _ in L.index(frequency) if L.TEMPLATES[t][0] == "mpl"]
    got = scanned(docs)
    assert got[0]["labels"] == ["mpl"] and got[0]["score"] == 1.0
    assert got[10]["labels"] == [] and got[10]["score"] == 0.5  # all indexed words in place, the phrase is not


def test_copies_that_hold_a_third_of_the_table(spark):
    docs = frame(spark, *["Released under the MIT License."] * 20, *[f"w{i} some prose" for i in range(40)])
    got = scanned(docs)
    assert all(got[i]["labels"] == ["mit"] for i in range(20)) and not any(got[i]["labels"] for i in range(20, 60))


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(None, "mit license", 1), (1, None, 2), (1, None, 2), (2, "MIT License", 3)], "doc_id long, text string, words int")
    got = sorted(((r["doc_id"], r["n_words"], r["labels"]) for r in L.licenses(docs).collect()), key=repr)
    assert got == [(1, 0, []), (1, 0, []), (2, 2, ["mit"]), (None, 2, ["mit"])]
    assert L.licenses(docs.limit(0)).count() == 0
    assert scanned(spark.createDataFrame([("a", "mit license")], "doc_id string, text string"))["a"]["labels"] == ["mit"]
    with pytest.raises(ValueError):
        L._phrases([("x", "a b", ["b c"])])


def test_very_long_texts_take_little_time(spark):
    many = "Released under the MIT License. " * 100_000
    long_word = "cc" * 2_000_000
    t = time.time()
    got = scanned(frame(spark, many, long_word, "all rights reserved " * 100_000))
    assert len(got[0]["places"]) == 100_000 and got[1]["n_words"] == 1
    assert got[2]["n_base"] == 100_000 and got[2]["last_word"] == 299_997
    assert time.time() - t < 60


def test_sql_equals_the_operator_on_made_documents(spark, tmp_path):
    texts = [t for _, t, _ in L.TEMPLATES] + [t.replace("license", "x") for _, t, _ in L.TEMPLATES] + \
        [f"{a} and {b}" for (_, a, _), (_, b, _) in zip(L.TEMPLATES, L.TEMPLATES[5:], strict=False)] + ["", None, "cc by cc by", "public license"]
    docs = frame(spark, *texts)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op13_licenses(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(L.SQL).df().sort_values("doc_id")
    for c in got.columns:
        assert [None if pd.isna(x) else x for x in got[c]] == [None if pd.isna(x) else x for x in want[c]], c
    assert (got["labels"] != "").sum() > len(L.TEMPLATES)
