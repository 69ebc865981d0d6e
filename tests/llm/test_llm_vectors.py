import numpy as np
import pytest

from binsight.llm import vectors as V


def expected(rows, least=0.9):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            good[k] = x / np.sqrt((x * x).sum())
    links = {k: [j for j in good if j != k and len(good[j]) == len(good[k]) and good[j] @ good[k] >= least] for k in good}
    label = {k: rows[k][0] for k in good}
    while True:
        new = {k: min([label[k], *(label[j] for j in links[k])]) for k in good}
        if new == label:
            break
        label = new
    return sorted((i, len(links.get(k, [])), label.get(k, i), label.get(k, i) == i) for k, (i, _) in enumerate(rows))


def corpus(seed, size=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        x = rng.normal(size=size)
        rows.append(x)
        rows += [x + rng.normal(size=size) * s for s in (0.05, 0.2, 0.4)]
    x = rng.normal(size=size)
    rows += [x + rng.normal(size=size) * 0.1 for _ in range(120)] + [x] * 30 + [x * 1e-30, x * 1e30, -x]
    rows = [r.tolist() for r in rows] + [None, [], [0.0] * size, [float("nan")] * size, [None] + [1.0] * (size - 1), [float("inf")] * size, [1.0, 2.0], [2.0, 4.0]]
    ids = rng.permutation(len(rows)).tolist()
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed,joined,block", [(1, 256, 1024), (2, 8, 16)])
def test_links_against_brute_force(spark, monkeypatch, seed, joined, block):
    monkeypatch.setattr(V, "JOINED", joined)
    monkeypatch.setattr(V, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, key int").repartition(3)
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(df).collect())
    want = expected(rows)
    found, there = sum(r[1] for r in out), sum(r[1] for r in want)
    assert len(out) == len(want) and there * 0.9 <= found <= there
    assert all(a[1] <= b[1] for a, b in zip(out, want))
    assert np.mean([a == b for a, b in zip(out, want)]) > 0.9


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        c = 0.9 + 0.1 * (i / 1500)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    out = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in out) / 2 > 0.95 * 1500


def test_all_documents_and_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in V.near_vectors(df).collect()) == expected(rows)
    assert V.near_vectors(df.limit(0)).collect() == []
    assert [tuple(r) for r in V.near_vectors(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")).collect()] == [(4, 0, 4, True)]


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    x = V.unit(rng.normal(size=(3000, 32)) @ rng.normal(size=(32, 32)) + 3)
    mean, turns = V.learned(x, 2, 32)
    assert all(np.allclose(t.T @ t, np.eye(32), atol=1e-8) for t in turns)
    share = ((x - mean) @ turns[0] >= 0).mean(axis=0)
    assert share.min() > 0.3 and share.max() < 0.7


def at_threshold(rng, n, size=64, mean=0.0, c=0.9):
    """Pairs of unit vectors at cosine c, all of which share a component of ``mean``."""
    a, b = (rng.normal(size=(n, size - 1)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = (c - mean ** 2) / (1 - mean ** 2)
    ends = a, c * a + np.sqrt(1 - c * c) * b
    return [np.hstack([np.full((n, 1), mean), np.sqrt(1 - mean ** 2) * e]) for e in ends]


@pytest.mark.parametrize("width,mean", [(20, 0.0), (27, 0.0), (24, 0.8)])
def test_keys_of_large_tables_find_pairs_at_the_threshold(width, mean):
    x, y = at_threshold(np.random.default_rng(5), 2000, mean=mean)
    model, _ = V.planned(x, width)
    assert (V.entries_of(x, model)[0] == V.entries_of(y, model)[0]).any(axis=1).mean() > 0.96


def test_recall_with_a_common_mean(spark):
    x, y = at_threshold(np.random.default_rng(6), 1500, mean=0.8, c=0.901)
    every = np.vstack([x, y])
    out = V.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")).collect()
    want = int((every @ every.T >= 0.9).sum()) - len(every)
    assert 0.96 * want < sum(r.n_links for r in out) <= want


def test_tables_of_few_or_equal_sample_vectors():
    for sample in (np.ones((1, 3)) / np.sqrt(3), np.ones((50, 3)) / np.sqrt(3), np.array([[1.0], [-1.0]])):
        (mean, axes, turns, width, tables), _ = V.planned(sample, 1)
        assert tables >= V.TABLES and V.entries_of(sample, (mean, axes, turns, width, tables))[0].shape == (len(sample), tables)


@pytest.mark.parametrize("mean", [0.0, 0.8])
def test_codes_of_pairs_at_the_threshold_differ_in_no_more_bits(mean):
    x, y = at_threshold(np.random.default_rng(7), 5000, mean=mean)
    model, differ = V.planned(x, 8)
    apart = sum(np.bitwise_count(a ^ b) for a, b in zip(V.entries_of(x, model)[1], V.entries_of(y, model)[1]))
    assert differ >= apart.max() and differ < 80
    assert mean == 0 or apart.max() > 40
