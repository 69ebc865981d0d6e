import hashlib
import random

import numpy as np
import pytest

from binsight.llm import substrings as S


def expected(rows, n=S.LENGTH):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            w = b[p:p + n]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        lost = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if seen[b[p:p + n]] > 1:
                lost[p:p + n] = True
        kept = np.frombuffer(b, np.uint8)[~lost].tobytes()
        spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
        out.append((i, len(b), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared = [noise(n) for n in (399, 400, 401, 700, 2500)]
    rows = [(i, noise(rng.randrange(0, 900)) + rng.choice(shared) + noise(rng.randrange(0, 900))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 3000), (103, "ab" * 900), (104, "ab" * 150), (105, noise(3000) + "\0" * 500 + noise(100) + "\0" * 500),
             (106, shared[4][100:1200] + shared[4][90:1300]), (107, rows[0][1]), (0, rows[0][1]), (None, noise(50) + shared[3]), (None, rows[1][1])]
    rows += [(200 + i, shared[3][:420] + noise(300)) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed,segments", [(1, 1024), (2, 2)])
def test_bytes_removed_are_those_of_brute_force(spark, monkeypatch, seed, segments):
    monkeypatch.setattr(S, "SHARD_SEGMENTS", segments)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, at int, kid string").repartition(4)
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(docs).collect()]
    assert sorted(out, key=repr) == expected(rows)


def test_many_frequent_minimizers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 2)
    monkeypatch.setattr(S, "LEVELS", 2)
    monkeypatch.setattr(S, "HOT_ROWS", 0)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(docs).collect()]
    assert sorted(out, key=repr) == expected(rows)


def test_a_common_phrase_sends_no_windows(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 20)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(500)) + "a phrase that all of them have" * 3
             + "".join(rng.choice("abcdef ") for _ in range(500))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    segments = S.candidates(S.keyed(docs))
    most = segments.groupBy("minimizer").count().agg({"count": "max"}).first()[0]
    assert (most or 0) <= 20


def test_nothing(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randrange(1, 400)
        raw = bytes(rng.choice(b"ab") for _ in range(n)) + bytes(rng.choice(b"ab") * rng.randrange(0, 60))
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        end = np.full(n, n)
        order, rank = S.suffix_order(data, end, 24)
        whole = [i for i in order.tolist() if i + 24 <= n]
        assert [raw[i:i + 24] for i in whole] == sorted(raw[i:i + 24] for i in range(n - 23))
        slots = np.flatnonzero(rank[order[1:]] == rank[order[:-1]]) + 1
        if len(slots):
            for s, got in zip(slots, S.common_prefixes(data, end, order, slots)):
                i, j = order[s], order[s - 1]
                k = 0
                while max(i, j) + k < n and raw[i + k] == raw[j + k]:
                    k += 1
                assert got == k


def test_segments_cover_each_window_once_and_equal_windows_share_a_minimizer(monkeypatch):
    monkeypatch.setattr(S, "STEP", 1000)
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 100, n, dtype=np.uint8) for n in (0, 399, 400, 950, 2600, 1001)]
    texts.append(texts[3])
    data, offsets = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
    seen, by = [], {}
    for doc, at, n, m, _ in S.segments(data, offsets):
        for d, a, k, key in zip(doc, at, n, m):
            for p in range(a, a + k):
                seen.append((d, p))
                by.setdefault(texts[d][p:p + 400].tobytes(), set()).add(int(key))
    assert sorted(seen) == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 399)]
    assert all(len(v) == 1 for v in by.values())


def test_segments_that_may_repeat_keep_every_common_window():
    """Segments with a common window stay, whatever side of the minimizer they share; those with a phrase alone go."""
    rng = np.random.default_rng(2)
    kept = dropped = 0
    for trial in range(60):
        share = int(rng.integers(100, 700))
        common = rng.integers(97, 123, share, dtype=np.uint8)
        texts = [np.concatenate([rng.integers(97, 123, int(rng.integers(300, 900)), dtype=np.uint8), common,
                                 rng.integers(97, 123, int(rng.integers(300, 900)), dtype=np.uint8)]) for _ in range(3)]
        data, offsets = np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts]))
        rows = [(int(m), int(d), bytes(data[offsets[i] + at:offsets[i] + at + n + S.LENGTH - 1]), int(n))
                for doc, a, c, mins, digs in S.segments(data, offsets)
                for i, at, n, m, d in zip(doc, a, c, mins, digs, strict=True)]
        rows = sorted({r[1]: r for r in rows}.values())
        pieces, n = [r[2] for r in rows], np.array([r[3] for r in rows])
        bounds = np.append(0, np.cumsum([len(p) for p in pieces]))
        on = S.may_repeat(np.frombuffer(b"".join(pieces), np.uint8), bounds, n)
        seen = {}
        for i, (p, k) in enumerate(zip(pieces, n, strict=True)):
            for w in range(k):
                seen.setdefault(p[w:w + S.LENGTH], set()).add(i)
        needed = {i for owners in seen.values() if len(owners) > 1 for i in owners}
        assert needed <= set(np.flatnonzero(on))
        kept, dropped = kept + len(needed), dropped + int((~on).sum())
    assert kept and dropped
