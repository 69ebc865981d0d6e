import hashlib
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binsight.llm import periodic as P
from binsight.llm.common import table
from conftest import SF_SMALL

SMALL = "doc_id long, text string"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:len(w) - q])


def brute_runs(words, least=24, times=3):
    out = []
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and smallest_period(words[i:i + length]) == q:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9)), max_size=9))
def test_runs_equal_brute_force(parts):
    words = [b"%d" % w for piece, times in parts for w in piece * times]
    assert P.word_runs(words) == brute_runs(words)
    assert P.word_runs(words, least=5) == brute_runs(words, least=5)


def test_long_periods_and_nested_runs():
    rng = random.Random(7)
    for period in (1, 7, 8, 9, 16, 17, 31, 32, 33, 64, 65, 130):
        inner = [b"x", b"y"] * 13
        piece = [b"%d" % rng.randrange(5) for _ in range(period)] + (inner if period > 30 else [])
        words = [b"p"] * 3 + piece * 4 + piece[:len(piece) // 2] + [b"q"]
        assert P.word_runs(words) == brute_runs(words)


def test_segments_are_stable_and_hold_every_run():
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(40) for _ in range(400)] + [b"a", b"b", b"c"] * 12 + [b"%d" % rng.randrange(900) for _ in range(500)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = P.np.array([number[w] for w in words])
    parts = P.segments(ids)
    for lo, hi in parts:
        assert hi - lo >= 24 and min(P.np.bincount(ids[lo:hi])[P.np.unique(ids[lo:hi])]) >= 3
    assert any(lo <= 400 and hi >= 436 for lo, hi in parts)


def test_query_equals_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    got = {r[0]: tuple(r) for r in P.op11_periodic(spark, SF_SMALL).collect()}
    want = {d: brute_row(d, t) for d, t in docs if len((t or "").split()) < 1500}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in want.values()) > 5
    assert {d: got[d] for d in want} == want


def test_awkward_rows(spark):
    rows = [(None, "a b " * 20, 1), (1, None, 1), (2, "", 1), (3, " \t\n", 1), (4, "a b " * 12, 1), (4, "a b " * 12, 1),
            (5, "é" + " x y  " * 30, 1), (6, "a b " * 11 + "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(map(tuple, P.periodic_runs(docs).collect()), key=repr)
    want = []
    for d, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        want.append((d, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted([(d, n, [P_row(*r) for r in runs], c) for d, n, runs, c in want], key=repr)
    assert P.periodic_runs(docs.limit(0)).count() == 0
    assert P.with_repeats(docs).count() == len(rows)
    with pytest.raises(ValueError):
        P.periodic_runs(docs, times=2)


def P_row(start, length, period):
    from pyspark.sql import Row
    return Row(start=start, length=length, period=period)


def test_text_ids(spark):
    docs = spark.createDataFrame([("d1", "x y z " * 9)], "doc_id string, text string")
    assert P.periodic_runs(P.with_repeats(docs)).first()["doc_id"] == "d1"


def test_very_long_texts_take_little_time():
    t = time.time()
    n = 300_000
    assert P.word_runs([b"w"] * n) == [(0, n, 1)]
    piece = [b"%d" % i for i in range(n // 3)]
    assert P.word_runs(piece * 3) == [(0, n // 3 * 3, n // 3)]
    sliding = [b"%d" % (i + j) for i in range(n // 3) for j in (2, 1, 0)]  # each round of splitting bares two more words
    assert P.word_runs(sliding) == []
    assert time.time() - t < 60
