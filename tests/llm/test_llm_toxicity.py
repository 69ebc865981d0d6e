import zlib

import numpy as np
import pyarrow as pa

from binsight.llm import toxicity as X
from binsight.llm.common import table

SF = "/root/testdata/sf0.1"


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("etaonrish"), rng.integers(2, 8))) for _ in range(500)]
    bad = ["scoundrel", "wretched", "vermin"]
    texts, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, rng.integers(5, 60)))
        if i % 5 == 0:
            own[::6] = rng.choice(bad, len(own[::6]))
        texts.append(" ".join(own))
        labels.append(int(i % 5 == 0))
    return texts, np.array(labels)


def test_unseen_misspellings_share_ngrams():
    texts, labels = sample(600)
    model = X.fit(pa.array(texts, pa.large_string()), labels)
    p = X.scores(pa.array(["you scoundrell", "WRETCHEDD!", "some verminn here", "the ration is thin", "", None]), *model)
    assert (p[:3] > 0.5).all() and (p[3:] < 0.5).all() and p[4] == p[5]
    assert ((p >= 0) & (p <= 1)).all()


def test_slices_change_nothing(monkeypatch):
    texts, labels = sample(200)
    model = X.fit(pa.array(texts, pa.large_string()), labels)
    column = pa.array([" ".join(texts), None, *texts[:20], "é" * 500])
    whole = X.scores(column, *model)
    monkeypatch.setattr(X, "STEP", 101)
    assert np.allclose(whole, X.scores(column, *model), atol=1e-9)


def test_rows_nulls_and_clashing_columns(spark):
    texts, labels = sample(300)
    docs = spark.createDataFrame([(i, t, 0.5, "p", 1) for i, t in enumerate(texts)] + [(None, None, 0.5, "p", 1), (3, texts[3], 0.5, "p", 1)],
                                 "doc_id long, text string, score double, predicted string, toxic int")
    marks = spark.createDataFrame([(i, int(y), 0) for i, y in enumerate(labels)] + [(3, None, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    out = X.scored(docs, X.train(docs.drop("toxic"), marks)).collect()
    assert len(out) == 302 and {r.predicted for r in out} <= {0, 1}
    right = np.mean([r.predicted == labels[r.doc_id] for r in out if r.doc_id is not None])
    assert right > 0.95
    empty = docs.limit(0)
    assert X.scored(empty, X.train(empty, marks)).collect() == []
    unlabelled = X.scored(docs, X.train(docs, marks.limit(0))).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_held_out_rows_are_never_trained_on(spark):
    ids = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in ids.select("doc_id", X.held_out("doc_id")).collect()}
    assert all(v == (zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0) for i, v in got.items())


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    from binsight.llm.toxicity import op3_toxicity
    rows = op3_toxicity(spark, SF).where("held_out").join(labels, "doc_id").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    # of these labels about one in sixteen toxic ones has no sign in its text
    assert auc > 0.92 and np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert docs.count() == op3_toxicity(spark, SF).count()


def test_copies_of_one_toxic_text_keep_its_insults():
    texts, labels = sample(600)
    clean = [t for t, y in zip(texts, labels) if not y]
    insults = ["blackguard", "poltroon", "miscreant"]
    copied = " ".join([*clean[0].split(), *insults * 4])
    texts, labels = clean + [copied] * (len(clean) // 2), np.array([0] * len(clean) + [1] * (len(clean) // 2))
    model = X.fit(pa.array(texts, pa.large_string()), labels)
    other = clean[1].split()[:12]
    p = X.scores(pa.array([copied, " ".join(other + insults * 2), "a poltroon and miscreant", "", None, *clean]), *model)
    assert (p[:3] > 0.5).all() and (p[3:5] < 0.5).all() and np.mean(p[5:] < 0.5) > 0.97


def test_a_sign_that_most_toxic_texts_share_is_learned():
    texts, labels = sample(600)
    shared = [t + " blackguard" if i % 3 == 0 else t for i, t in enumerate(t for t, y in zip(texts, labels) if not y)]
    labels = np.array([int(t.endswith("blackguard")) for t in shared])
    model = X.fit(pa.array(shared, pa.large_string()), labels)
    p = X.scores(pa.array(["blackguard", "the ration is thin blackguard", "the ration is thin"]), *model)
    assert (p[:2] > 0.5).all() and p[2] < 0.5
