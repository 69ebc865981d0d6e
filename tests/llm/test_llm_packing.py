import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binsight.llm import packing as K

ODD = ["a c d é <|endoftext|>x's 'RE'd  Σας ́x \x85 y it's. İx, ÉA, 'S. A'. x.' 5. <|ENDOFTEXT|>. K, ſ.", "",
       "a\x1cb\x0b\xa0 x y", " ", "Ａ．B 한글 12.5, ... a.,b wORD. 𝒳!", "x" * 5000]


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.default_tokenizer())


def test_words_give_the_ids_of_whole_texts(encoder):
    ids, first = encoder.encode(pa.array(ODD))
    assert [ids[a:b].tobytes() for a, b in zip(first, first[1:])] == encoder.ids(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_is_encoded_as_a_whole_is(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, first = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tobytes() for a, b in zip(first, first[1:])] == encoder.ids(texts)


def test_full_cache_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(K, "CACHE", 1)
    for _ in range(2):
        ids, first = encoder.encode(pa.array(ODD))
        assert [ids[a:b].tobytes() for a, b in zip(first, first[1:])] == encoder.ids(ODD)


def test_combinations_are_all_partitions_of_few_parts():
    want = {tuple(sorted(c, reverse=True)) for n in (1, 2, 3) for c in itertools.product(range(1, 13), repeat=n) if sum(c) == 12}
    found = K.combinations(12, 3)
    assert set(found) == want and len(found) == len(want)


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 15)), rng.normal(size=8)
        x = K.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and (np.abs(slope[x > 0]) < 1e-6).all()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 127), st.integers(1, 300), max_size=30),
       st.dictionaries(st.integers(1, 32).map(lambda k: 128 * k), st.integers(1, 300), max_size=12))
def test_plan_places_each_piece_once_without_gaps(tails, mains):
    plan = K.Plan(tails, mains)
    held = {}
    for k, n in (tails | mains).items():
        window, at = plan.place(np.full(n, k), np.arange(n))
        for w, o in zip(window, at):
            held.setdefault(int(w), []).append((int(o), k))
    for spots in held.values():
        end = 0
        for o, k in sorted(spots):
            assert o == end
            end += k
        assert end <= 4096
    assert sorted(held) == list(range(len(held)))


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = {}
    for r in K.pack(docs, K.default_tokenizer()).collect():
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert 4096 * len(sums) < 1.01 * sum(sums.values())


def _docs(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def test_pack_every_id_once(spark, encoder):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "heat", "Worden,", "é", "xqzj"], n)) for n in (0, 1, 5, 90, 4096, 9000, 300, 300)]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(50, None, "y", 6), (None, "the", "y", 6), (6, texts[6], "x", 5)]
    out = K.pack(_docs(spark, rows, "doc_id long, text string, length string, rank int").repartition(3), K.default_tokenizer()).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        ids = encoder.ids([t or ""])[0] + np.array([2], "<u4").tobytes()
        mine = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[i]})
        assert len(by[i]) == len(mine) * (2 if i == 6 else 1)
        assert b"".join(ids[4 * s:4 * (s + n)] for s, n, _, _ in mine) == ids
        assert all(zlib.crc32(ids[4 * s:4 * (s + n)]) == c and d == len(ids) // 4 for s, n, c, d in mine)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in seqs.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:]))
        assert sum(n for _, n in spots) <= 4096


def test_pack_nothing(spark):
    assert K.pack(_docs(spark, []), K.default_tokenizer()).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 127), st.integers(1, 300), max_size=30),
       st.dictionaries(st.integers(1, 32).map(lambda k: 128 * k), st.integers(1, 300), max_size=12))
def test_cut_plan_fills_all_windows_but_the_last(tails, mains):
    plan = K.Plan(tails, mains, cut=True)
    held = {}
    for k, n in (tails | mains).items():
        window, at = plan.place(np.full(n, k), np.arange(n))
        for w, o in zip(window.tolist(), at.tolist()):
            own = min(k, 4096 - o)
            held.setdefault(w, []).append((o, own))
            if own < k:
                assert k < 128 or own % 128 == 0
                held.setdefault(w + 1, []).append((0, k - own))
    for spots in held.values():
        end = 0
        for o, k in sorted(spots):
            assert o == end
            end += k
    assert sorted(held) == list(range(len(held)))
    total = sum(k * n for k, n in (tails | mains).items())
    assert len(held) == -(-total // 4096)


def test_crc_of_joined_strings():
    parts = [bytes([i]) * 512 for i in range(5)]
    assert K.joined_crc([zlib.crc32(p) for p in parts], 512) == zlib.crc32(b"".join(parts))
    assert K.joined_crc([], 512) == 0


@pytest.mark.parametrize("tokens", [2176, 1408, 100, 127, 3000])
def test_awkward_lengths_fill_windows(spark, encoder, tokens):
    words = ["the", "of", "and", "to", "was"]
    rng = np.random.default_rng(tokens)
    texts = [" ".join(rng.choice(words, tokens - 1)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = K.pack(_docs(spark, rows).repartition(3), K.default_tokenizer()).collect()
    assert len({r.sequence_id for r in out}) == -(-60 * tokens // 4096)
    for i, t in rows:
        ids = encoder.ids([t])[0] + np.array([2], "<u4").tobytes()
        mine = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert b"".join(ids[4 * s:4 * (s + n)] for s, n, _ in mine) == ids and len(ids) == 4 * tokens
        assert all(zlib.crc32(ids[4 * s:4 * (s + n)]) == c for s, n, c in mine)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in seqs.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:]))
        assert sum(n for _, n in spots) <= 4096


def test_very_long_text_and_word(spark, encoder):
    texts = ["the heat " * 60_000, "x" * 300_000]
    out = K.pack(_docs(spark, list(enumerate(texts))), K.default_tokenizer()).collect()
    for i, t in enumerate(texts):
        ids = encoder.ids([t])[0] + np.array([2], "<u4").tobytes()
        mine = sorted((r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert b"".join(ids[4 * s:4 * (s + n)] for s, n, _ in mine) == ids
        assert all(zlib.crc32(ids[4 * s:4 * (s + n)]) == c for s, n, c in mine)
