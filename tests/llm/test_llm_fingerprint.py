import hashlib
import random

import numpy as np
import pytest

from binsight.llm import fingerprint as P


def text(rng, n):
    return " ".join(rng.choice(["the", "heat", "Wörd,", "of", "xq"]) + str(rng.randrange(300)) for _ in range(n))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + after[:k]
        a, b, c = P.sketches([t, edited, after])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.encoded(a), P.encoded(b),
                    P.likeness(a, b), P.likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,buckets", [(1, 4), (2, 1), (40, 1), (40, 7), (40, 200)])
def test_every_row_meets_its_next(spark, n, buckets):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6), text(rng, rng.choice([0, 1, 3, 50, 400]))) for _ in range(n)]
    if n > 2:
        rows += [(5, None), (rows[0][0], rows[0][1]), (rows[1][0], "other words for the same id"), (None, "no id at all"), (None, None), (-3, "é")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, ghost int").repartition(5)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
           for r in P.fingerprints(docs, buckets=buckets).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_no_rows(spark):
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_estimate_and_merge():
    rng = random.Random(1)
    whole = [f"w{rng.randrange(10**9)}" for _ in range(8000)]
    part = whole[:1600]
    a, b = P.sketches([" ".join(whole), " ".join(part)])
    assert abs(P.containment(b, a) - 1) < 0.01 and abs(P.containment(a, b) - 0.2) < 0.04 and abs(P.likeness(a, b) - 0.2) < 0.04
    x, y = P.sketches([" ".join(whole[:4002]), " ".join(whole[3998:])])  # shingles across the cut are in one of them
    assert np.array_equal(P.merged(x, y), a)
    assert np.array_equal(P.decoded(P.encoded(a)), a) and P.encoded(a[:0]) == ""


def test_long_text_is_hashed_as_short_ones_are(monkeypatch):
    rng = random.Random(3)
    t = "  ".join(text(rng, 3000).split()) + " " + "z" * 3000 + " end"
    whole = P.sketches([t, "", t])
    from binsight.llm import common
    monkeypatch.setattr(common, "SLICE_BYTES", 700)
    assert all(np.array_equal(a, b) for a, b in zip(whole, P.sketches([t, "", t])))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 60_000])
def test_bounds_above_a_value(spark, n):
    from pyspark.sql import functions as F

    bounds = [3 * (n - i) for i in range(n)]
    values = [None, -1, 0, 2, 3, 4, 3 * n - 1, 3 * n, 3 * n + 1, 3 * (n // 2)]
    got = (spark.createDataFrame(list(enumerate(values)), "i int, v long")
           .select("i", P._above(bounds, F.col("v")).alias("above")).orderBy("i").collect())
    assert [r.above for r in got] == [None if v is None else sum(b > v for b in bounds) for v in values]
