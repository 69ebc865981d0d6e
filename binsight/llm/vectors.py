"""Near-duplicate vectors by iterative quantisation (operator 7).

Rotations learned on a bounded sample make balanced binary codes.  Substrings
of the codes index every vector in several Hamming tables; two vectors that
share an entry are candidates, and their original vectors decide.  Tables are
added until pairs at the threshold, made from the sample, share entries.  Equal
vectors are one class from the start.  Small buckets are joined.  A large one
is cut into blocks, and each pair of blocks compared as a whole: it returns
link counts and a forest, no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import mix, partitions, table, written
from binsight.llm.graph import components

LEAST = 0.9
#: Vectors in the sample that rotations are learned on, and rounds of learning.
SAMPLE_ROWS, ROUNDS, SEED = 20_000, 25, 3
#: Bits of a code (or the vectors' dimension, if lower), Hamming tables at least, and at most before keys get shorter.
CODE_BITS, TABLES, MOST_TABLES = 64, 36, 512
#: Share of the pairs at the threshold that must share an entry, and pairs it is measured on.
RECALL, PAIRS = 0.98, 4000
#: Buckets of more vectors are compared in blocks of this many.
JOINED, BLOCK = 256, 1024
#: Of 128 bits of two codes, how many may always differ (at cosine 0.9 these are 18 on average, with a deviation of 4,
#: without a common mean); and how many more than differ in any of the pairs at the threshold.
DIFFER, MARGIN = 40, 8


def basis(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions (dimension x bits)."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x / max(len(x), 1))
    return mean, axes[:bits].T


def rotation(v: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Brings projected vectors close to the corners of a cube, from a random start."""
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def learned(sample: np.ndarray, rotations: int, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and projections (rotations x dimension x bits), by iterative quantisation: principal directions, then rotations."""
    rng = np.random.default_rng(SEED)
    mean, axes = basis(sample, bits)
    v = (sample - mean) @ axes
    return mean, np.stack([axes @ rotation(v, rng, rounds) for _ in range(rotations)])


def pairs_at(sample: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample, and for each one at a cosine of ``least``, on the way to another of the sample."""
    x, z = (sample[rng.integers(0, len(sample), PAIRS)] for _ in range(2))
    cosine = (x * z).sum(axis=1, keepdims=True)
    away = z - cosine * x
    far = np.sqrt((away * away).sum(axis=1, keepdims=True))
    on = ((cosine < least) & (far > 1e-6)).ravel()
    return x[on], least * x[on] + np.sqrt(1 - least * least) * away[on] / far[on]


def planned(sample: np.ndarray, width: int, least: float = LEAST) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, int, int], int]:
    """Model (mean, directions, rotations, bits of a key and number of tables),
    so that RECALL of the pairs at the threshold share an entry; and how many
    bits of two codes may differ, which is more than in any of these pairs.

    If that takes more than MOST_TABLES, keys get shorter: their larger buckets
    are compared all the same.
    """
    bits = min(sample.shape[1], CODE_BITS)
    rng = np.random.default_rng(SEED)
    mean, axes = basis(sample, bits)
    v = (sample - mean) @ axes
    ends = [(x - mean) @ axes for x in pairs_at(sample, least, np.random.default_rng(SEED + 1))]
    turns, same = [], []

    def turn(r):
        while len(turns) <= r:
            turns.append(rotation(v, rng, ROUNDS))
            same.append((ends[0] @ turns[-1] >= 0) == (ends[1] @ turns[-1] >= 0))
        return same[r]

    both = np.concatenate([turn(0), turn(1)], axis=1)
    agree, differ = both.mean(axis=1), max(DIFFER, int((~both).sum(axis=1).max(initial=0)) + MARGIN)
    while width > 1 and len(agree) and 1 - (1 - (agree ** width).mean()) ** MOST_TABLES < RECALL:
        width -= 1
    while True:
        each = bits // width
        found, tables = np.zeros(len(agree), bool), 0
        while tables < TABLES or (len(found) and found.mean() < RECALL and tables < MOST_TABLES):
            found |= turn(tables // each)[:, :each * width].reshape(len(found), each, width).all(axis=2).any(axis=1)
            tables += each
        if width == 1 or not len(found) or found.mean() >= RECALL:
            return (mean, axes, np.stack(turns[:max(2, -(-tables // each))]), width, tables), differ
        width -= 1


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def entries_of(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray, int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys (an entry in each table) and two codes of unit vectors."""
    mean, axes, turns, width, tables = model
    size, bits = axes.shape
    v = (x - mean) @ axes
    keys, codes = [], []
    for r in range(len(turns)):
        on = v @ turns[r] >= 0
        if r < 2:
            codes.append((on << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
        for a in range(0, bits - width + 1, width):
            if len(keys) < tables:
                code = (on[:, a:a + width] << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                keys.append(mix(mix(code + np.uint64(len(keys) << 32)) + np.uint64(size << 44) + np.uint64(len(keys))))
    return np.stack(keys, axis=1), codes


def coded(vectors: DataFrame, size: int, model: tuple[np.ndarray, np.ndarray, np.ndarray, int, int]) -> DataFrame:
    """node, times, v -> with keys (an entry in each table) and two codes h1, h2."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def look(batches):
        for batch in batches:
            x = unit(matrix(batch["v"], size))
            keys, codes = entries_of(x, held.value)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["times"], batch["v"],
                 pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
                 *(pa.array(c.view(np.int64)) for c in codes)], ["node", "times", "v", "keys", "h1", "h2"])

    return vectors.mapInArrow(look, "node long, times long, v array<double>, keys array<long>, h1 long, h2 long")


def _reranked(least: float):
    """Candidate pairs, with vectors and entries, to links; pairs that share a large bucket are left to its blocks."""
    def look(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch["va"])
            for size in pc.unique(sizes).to_pylist():
                some = batch.filter(pc.equal(sizes, size))
                cosine = (unit(matrix(some["va"], size)) * unit(matrix(some["vb"], size))).sum(axis=1)
                x, y = (some[c].flatten().to_numpy().reshape(some.num_rows, -1) for c in ("la", "lb"))
                on = pa.array((cosine >= least) & ~((x == y) & (x != 0)).any(axis=1))
                yield some.select(["a", "b", "ta", "tb"]).filter(on)

    return look


def _blocks(least: float):
    """Pairs of blocks, sorted by (key, i, j), to link counts and edges of a forest."""
    def forest(link, node):
        label = node.copy()
        while True:
            new = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == label).all():
                return label
            label = new

    def out(rows):
        node, times, side = (rows[c].to_numpy() for c in ("node", "times", "side"))
        n, key = len(node), rows["key"][0].as_py()
        x = unit(matrix(rows["v"].combine_chunks(), len(rows["v"][0])))
        large = rows["large"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        same = rows["i"][0].as_py() == rows["j"][0].as_py()
        link = x @ x.T >= least
        np.fill_diagonal(link, False)
        if not same:
            link &= side[:, None] != side[None, :]
        # a pair is counted in the first table of which it shares a large bucket
        t = int(np.flatnonzero((large == key).all(axis=0))[0])
        for before in range(t):
            link &= ~((large[:, None, before] == large[None, :, before]) & (large[:, None, before] != 0))
        count = link @ times
        label = forest(link, node)
        on = count > 0
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(count[on]), pa.array(label[on])],
                                          ["node", "links", "root"])

    def look(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [*(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            lo = 0
            for hi in cuts:
                key = tuple(ids[:, lo])
                if held and key != last:
                    yield out(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last, lo = key, hi
        if held:
            yield out(pa.Table.from_batches(held))

    return look


def usable(column: str) -> F.Column:
    v = F.col(column)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """rows (vec_id, embedding, any more) -> a row per row: vec_id, n_links,
    component_id, kept.

    Links have a cosine of at least ``least``, in double precision.  Vectors
    that are null, zero or hold null or non-finite components link with
    nothing; nor do vectors of different dimensions.  Repeated rows link with
    each other.  Rows of one vec_id are one node of the components.
    """
    spark = rows.sparkSession
    doubles = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    plain = rows.select("vec_id", F.when(usable("embedding"), doubles).alias("v"))
    plain = plain.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"))
    good = plain.where("v IS NOT NULL")
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"), F.size(F.first("v")).alias("size"))
    classes = written(classes.withColumn("node", F.coalesce("first", F.col("k1").bitwiseOR(F.lit(-(1 << 63))))), "classes")
    one = (good.join(classes, ["k1", "k2"]).where(F.col("vec_id").eqNullSafe(F.col("first")))
           .select("node", "times", "v", "k1", "k2").dropDuplicates(["k1", "k2"]).drop("k1", "k2"))
    counts = [(r[0], r[1]) for r in classes.groupBy("size").count().orderBy("size").collect()]
    parts, differ = [], DIFFER
    for size, n in counts:
        own = one.where(F.size("v") == size)
        sample = own.orderBy(F.xxhash64("node")).limit(max(1000, min(SAMPLE_ROWS, (1 << 24) // size))).select("v").collect()
        bits = min(size, CODE_BITS)
        width = max(min(bits, math.ceil(math.log2(max(n, 2)))), min(bits, 8))
        model, most = planned(unit(np.array([r[0] for r in sample])), width, least)
        parts.append(coded(own, size, model))
        differ = max(differ, most)
    if not parts:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = written(every, "codes")
    entries = every.select("node", "h1", "h2", F.posexplode("keys").alias("t", "key"))
    sizes = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    few, many = sizes.where(F.col("n") <= JOINED).select("key"), sizes.where(F.col("n") > JOINED)
    # entries of large buckets by table; 0 in the others
    big = (entries.join(many, "key").groupBy("node")
           .agg(F.map_from_entries(F.collect_list(F.struct("t", "key"))).alias("m")))
    large = F.transform("keys", lambda k, t: F.coalesce(F.try_element_at("m", t), F.lit(0)))
    vectors = written(every.join(big, "node", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,bigint>")))
                      .select("node", "times", "v", large.alias("large")), "vectors")

    slots = entries.join(few, "key").select("key", "node", "h1", "h2")
    x, y = slots.alias("x"), slots.alias("y")
    apart = F.bit_count(F.col("x.h1").bitwiseXOR(F.col("y.h1"))) + F.bit_count(F.col("x.h2").bitwiseXOR(F.col("y.h2")))
    pairs = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (apart <= differ))
             .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    side = lambda s: vectors.select(F.col("node").alias(s), F.col("times").alias(f"t{s}"), F.col("v").alias(f"v{s}"),
                                    F.col("large").alias(f"l{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    links = written(joined.mapInArrow(_reranked(least), "a long, b long, ta long, tb long"), "links")

    spread = (entries.join(many, "key").select("key", "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
              .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side")))
    blocks = (spread.join(vectors, "node").select("key", "i", "j", "side", "node", "times", "v", "large")
              .repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j"))
    found = written(blocks.mapInArrow(_blocks(least), "node long, links long, root long"), "blocks")

    edges = (links.select(F.col("a").alias("u"), F.col("b").alias("v"))
             .unionByName(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))))
    label = components(edges)
    degree = (links.select(F.col("a").alias("node"), F.col("tb").alias("links"))
              .unionByName(links.select(F.col("b").alias("node"), F.col("ta").alias("links")))
              .unionByName(found.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links")))
    summary = (classes.join(degree, "node", "left").join(label, "node", "left")
               .select("k1", "k2", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("label", "node").alias("label")))
    usable_ = F.col("v").isNotNull()
    return (plain.join(summary, ["k1", "k2"], "left")
            .select("vec_id", F.when(usable_, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
                    F.when(usable_, F.col("label")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


@register("op7_vectors")
def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
