import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from binsight.llm import trie as T
from binsight.llm.common import table, written
from conftest import SF_SMALL

SMALL = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """conv_id -> [(role, text)] by turn, null first."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def brute_rebuilt(own):
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + seq[h:]
    return out


def brute_nodes(convs):
    members, children, ends = {}, {}, {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            key = tuple(seq[:d])
            members.setdefault(key, []).append(c)
            children.setdefault(key, set())
            if d:
                children[key[:-1]].add(key)
        ends.setdefault(tuple(seq), []).append(c)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        saved[key] = (len(members[key]) - 1) * words + sum(saved[k] for k in children[key])
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple(-1 if v is None else v for v in r))


def same(df, convs):
    want = sorted(brute_nodes(convs), key=lambda r: tuple(-1 if v is None else v for v in r))
    assert got(df) == want


def rows_of(convs):
    return [(c, i, r, t) for c, seq in convs.items() for i, (r, t) in enumerate(seq)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 20000])
def test_slot_table_is_minimal_perfect_and_knows_strangers(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(-2**63, 2**63 - 1, (2, n))
    if n > 2:
        x[1] = x[0]  # half a digest in common
    slots = T.SlotTable(x, y)
    assert sorted(slots.find(x, y)) == list(range(n))
    assert (slots.find(x, y + 1) == -1).all() and (slots.find(x[::-1].copy() ^ 5, y) == -1).all()


def test_a_digest_of_two_prefixes_is_refused():
    one = np.ones(2, np.int64)
    with pytest.raises(ValueError):
        T.shard_nodes(one, one, one, np.array([0, 7]), one, np.array([1, 2]), one, one)


def test_registered_query_equals_brute_force(spark):
    rows = table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()
    same(T.op12_trie(spark, SF_SMALL), brute_rebuilt(sequences(rows)))


@pytest.mark.parametrize("shard_rows", [1, 12, 50_000])
def test_tries_of_many_shapes(spark, shard_rows):
    rng = random.Random(5)
    convs = {c: [(rng.choice("ab"), rng.choice(["x", "x y", "z"])) for _ in range(rng.randrange(6))] for c in range(120)}
    convs |= {200 + c: [("u", "hot first turn"), ("v", str(c % 7)), ("u", "same")] for c in range(60)}  # copies and one hot turn
    convs |= {-3: [("u", "neg")], 500: [("t", str(i % 3)) for i in range(90)]}  # a long chain
    convs |= {600 + k: [("t", str(i % 3)) for i in range(k)] + [("w", "off")] for k in range(0, 60, 7)}  # leaving it at many places
    rows = rows_of(convs)
    rng.shuffle(rows)
    df = T.prefix_trie(spark.createDataFrame(rows, SMALL), shard_rows=shard_rows)
    same(df, {c: s for c, s in convs.items() if s})


def test_rebuilt_conversations(spark):
    rng = random.Random(9)
    convs = {c: [("r", f"{rng.randrange(2)}") for _ in range(rng.randrange(1, 6))] for c in [*range(100), 1007, 1040, 1041, -1]}
    own = written(T.placed(T.turns(spark.createDataFrame(rows_of(convs), SMALL))), "turns")
    df = T.nodes(T.rebuilt(own), own.where("place = 1"), 10)
    spark_base = {c: brute_rebuilt(convs)[c] for c in convs if c >= 0}
    h = zlib.crc32(b"-1") % 4
    same(df, spark_base | {-1: convs.get(0, [])[:h] + convs[-1][h:]})  # % keeps the sign, as in SQL


def test_one_conversation_holds_a_third_of_the_rows(spark):
    convs = {c: [("r", "a"), ("r", str(c))] for c in range(300)} | {7: [("r", str(i % 5)) for i in range(400)]}
    rows = spark.createDataFrame(rows_of(convs), SMALL)
    parts = T._running(T.turns(rows).selectExpr("*", "0L AS x", "0L AS y"), ["conv_id", "turn"])
    assert sorted(r["at"] for r in parts.where("conv_id = 7").collect()) == list(range(1, 401))
    same(T.prefix_trie(rows, shard_rows=50), convs)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "a", None), (1, 0, "a", None), (2, None, "", ""), (2, 5, "a", ""), (None, 1, "a", "lost"),
            (3, 1, "a:b", "c"), (4, 1, "a", ":bc"), (5, 0, "a", "w " * 50_000)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], SMALL + ", depth int, x int")
    same(T.prefix_trie(df), sequences(rows))
    assert T.prefix_trie(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        T.prefix_trie(df.withColumn("conv_id", T.F.col("conv_id").cast("string")))
