import random

import numpy as np
import pyarrow as pa
import pytest

from binsight.llm import neardup as N
from binsight.llm.common import flat, lowered, shingles, words
from binsight.llm.graph import components


def bag(text, k=5):
    w = (text or "").lower().split()
    found = {}
    for i in range(max(1, len(w) - k + 1) if w else 0):
        s = tuple(w[i:i + k])
        found[s] = found.get(s, 0) + 1
    return found


def plain(a, b):
    """Probability Jaccard as it is defined, term by term."""
    if not a or not b:
        return float(not a and not b)
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in a.keys() & b.keys())


def signed(texts):
    h, first = shingles(*words(*flat(lowered(pa.array(texts, pa.large_string())))))
    return N.signatures(*N.weighted(h, first), len(texts), 4000)


def text(rng, n):
    return " ".join(f"w{rng.randrange(60)}" for _ in range(n))


def edited(rng, t, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in t.split())


def test_registers_agree_as_often_as_the_similarity_says():
    rng = random.Random(5)
    base = " ".join([text(rng, 120)] + ["the same line again and again"] * 15)
    other = " ".join([edited(rng, base, 0.03)] + ["the same line again and again"] * 5)
    short, longer = "one two three four five six", "one two three four five six seven"
    got = signed([base, other, short, longer, "a b", "a b", "one", ""])
    for i, j, a, b in ((0, 1, base, other), (2, 3, short, longer)):
        assert abs((got[i] == got[j]).mean() - plain(bag(a), bag(b))) < 0.035
    assert (got[4] == got[5]).all() and (got[4] != got[6]).all() and (got[7] == 0).all() and (got[:7] != 0).all()


def test_similarity_is_the_definition():
    rng = random.Random(6)
    for _ in range(60):
        a = {i: rng.randrange(1, 5) for i in rng.sample(range(12), rng.randrange(0, 9))}
        b = {i: rng.randrange(1, 5) for i in rng.sample(range(12), rng.randrange(0, 9))}
        x, y = ((np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (a, b))
        assert abs(N.similarity(x, y) - plain(a, b)) < 1e-12


def grouped(rows, least=0.8):
    """Class of each row by comparing all pairs."""
    nodes = {}
    for i, t in rows:
        nodes.setdefault(" ".join((t or "").lower().split()), []).append(i)
    keys, bags = list(nodes), [bag(k) for k in nodes]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if bags[i] and bags[j] and plain(bags[i], bags[j]) >= least:
                parent[find(i)] = find(j)
    low = {}
    for i, k in enumerate(keys):
        low[find(i)] = min([low.get(find(i), 10**9), *nodes[k]])
    return {i: low[find(k)] for k, key in enumerate(keys) for i in nodes[key]}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = text(rng, rng.choice([4, 6, 30, 80, 200]))
        rows += [base, base.upper(), "  " + base.replace(" ", "\n", 1)]
        rows += [edited(rng, base, s) for s in (0.004, 0.01, 0.02, 0.2)]
    rows += ["", None, " ", "one", "one", "two"]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1])
def test_classes_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 0, "n") for r in rows], "doc_id long, text string, class_id int, node string").repartition(4)
    out = N.near_duplicates(docs).collect()
    want = grouped(rows)
    assert {r.doc_id: r.class_id for r in out} == want and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = text(rng, 150)
    rows = [(i, edited(rng, base, 0.012)) for i in range(150)] + [(500 + i, base) for i in range(60)] + [(900 + i, text(rng, 150)) for i in range(20)]
    out = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == grouped(rows)


def test_rows_without_ids_repeated_rows_and_nothing(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, "a b c"), (None, "x y"), (None, "x y"), (7, None)]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and sorted(r.kept for r in out) == [False, True, True, True, True, True]
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
