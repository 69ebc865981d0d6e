"""Near-duplicate documents by ProbMinHash signatures (operator 1).

A document is a bag of word shingles, weighted by how often they occur.  Each
shingle is a Poisson process of its weight as rate, seeded by its hash; every
arrival picks a register, and a register keeps the shingle that reached it
first.  Shingles whose next arrival comes after the last register was filled
stop.  Registers of two documents agree with the probability Jaccard
similarity.  Bands of registers give candidates, whose similarity is then
computed exactly from their whole texts.

Documents of equal word sequences are one class from the start.  In a band's
bucket the class that shares most buckets is compared with the others.  Buckets
that then still hold several components are compared block by block: shared
shingles are counted by a matrix product, and a pair of blocks returns a forest
of the links between its components, no pairs.  So no link is lost that would
join two components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import flat, lowered, mix, partitions, shingles, table, text_slices, words, written
from binsight.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS = 7e-5.
BANDS, ROWS = 24, 5
#: Documents in a block, and shingles whose columns are multiplied at once.
BLOCK, COLUMNS = 1024, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.cumprod(np.full(ROWS, 0xD1342543DE82EF95, dtype=np.uint64))


def weighted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))
    _, at, count = np.unique(own, return_index=True, return_counts=True)
    return doc[at], h[at], count


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (texts x size) of weighted items; 0 where a text has none."""
    first = np.full(texts * size, np.inf)
    kept = np.zeros(texts * size, np.uint64)
    time, state = np.zeros(len(item)), item.copy()
    while len(item):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight
        register_ = ((mix(draw ^ _STEP) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        at = doc * size + register_.astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = item[won]
        # the next arrival is later still: an item that is past all registers is done
        here = np.unique(doc)
        last = np.full(texts, -1.0)
        last[here] = first.reshape(texts, size)[here].max(axis=1)
        on = time < last[doc]
        doc, item, weight, time, state = doc[on], item[on], weight[on], time[on], state[on]
    return kept.reshape(texts, size)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two bags, given as sorted items and counts; 1 for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    ratio, n = np.unique(y[both] / x[both], return_counts=True)
    total = 0.0
    for r, _ in zip(ratio, n, strict=True):
        some = both & (y == r * x) if r == 1 else both & np.isclose(y, r * x)
        total += y[some].sum() / np.maximum(x * r, y).sum()
    return total


def sketched(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, word sequence key (c1, c2), words, and band keys of each row."""
    def look(batches):
        for batch in batches:
            column = lowered(batch["text"])
            for lo, hi in text_slices(column):
                n = hi - lo
                h, first = words(*flat(column.slice(lo, n)))
                at = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                keys = []
                for seed in (1, 2):
                    part = np.append(mix(h ^ mix(at.astype(np.uint64) * _STEP + np.uint64(seed))), np.uint64(0))
                    total = np.add.reduceat(part, first[:-1])
                    total[first[:-1] == first[1:]] = 0
                    keys.append(mix(total + np.diff(first).astype(np.uint64) * np.uint64(seed + 2)))
                doc, item, count = weighted(*shingles(h, first, k))
                marks = signatures(doc, item, count, n).reshape(n, BANDS, ROWS)
                band = mix((marks * _ORDER).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, n), *(pa.array(x.view(np.int64)) for x in keys),
                     pa.array(np.diff(first)), pa.ListArray.from_arrays(offsets, pa.array(band.ravel().view(np.int64)))],
                    ["doc_id", "c1", "c2", "words", "bands"])

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, c1 long, c2 long, words long, bands array<long>")


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, text of each class's document."""
    return docs.select(F.col("doc_id").alias("rep"), "text").join(reps.select("rep", "node"), "rep").select("node", "text")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, least: float, k: int = SHINGLE) -> DataFrame:
    """Those of pairs (a, b: nodes) whose documents' similarity is at least ``least``, with it."""
    def look(batches):
        for batch in batches:
            for lo, hi in text_slices(batch["text_a"], 1 << 20):
                part = batch.slice(lo, hi - lo)
                bags = []
                for column in (part["text_a"], part["text_b"]):
                    h, first = shingles(*words(*flat(lowered(column))), k)
                    bags.append([np.unique(h[i:j], return_counts=True) for i, j in zip(first[:-1], first[1:], strict=True)])
                s = np.array([similarity(x, y) for x, y in zip(*bags, strict=True)])
                on = pa.array(s >= least)
                yield pa.RecordBatch.from_arrays([part["a"].filter(on), part["b"].filter(on), pa.array(s).filter(on)],
                                                 ["a", "b", "similarity"])

    texts = _texts(docs, reps)
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(look, "a long, b long, similarity double")


def _forest(bags: list, label: np.ndarray, other: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of positions that link different components, as few as join them.

    ``bags``: (sorted shingles, counts) of each document; ``other``: the pairs to
    look at, as a matrix.  Bags without repeats are decided by the number of
    shared shingles; for others that gives a bound, and the rest is exact.
    """
    n = len(bags)
    sizes = np.array([len(b[0]) for b in bags])
    doc, item = np.repeat(np.arange(n), sizes), np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] / max(b[1].sum(), 1) for b in bags])
    every, at, times = np.unique(item, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    on = shared[at]
    doc, column, weight = doc[on], place[at[on]], weight[on]
    by = np.argsort(column, kind="stable")
    doc, column, weight = doc[by], column[by], weight[by]
    both, mass = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        has, part = np.zeros((2, n, min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        has[doc[a:b], column[a:b] - lo], part[doc[a:b], column[a:b] - lo] = 1, weight[a:b]
        both += has @ has.T
        mass += part @ has.T
    single = np.array([bool((b[1] == 1).all()) for b in bags])
    exact = single[:, None] & single[None, :]
    link = other & exact & (both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-3)
    open_ = other & ~exact & (np.minimum(mass, mass.T) >= least - 1e-4)
    root = {x: x for x in label.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for pairs in (link, open_):
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(pairs, 1))), strict=True):
            a, b = find(int(label[i])), find(int(label[j]))
            if a != b and similarity(bags[i], bags[j]) >= least:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _compared(least: float, k: int):
    """Blocks (key, i, j; node, label, side, text), sorted, to links that join components."""
    def out(rows):
        node, label, side = (rows[c].to_numpy() for c in ("node", "label", "side"))
        bags = []
        for lo, hi in text_slices(rows["text"].combine_chunks()):
            h, first = shingles(*words(*flat(lowered(rows["text"].combine_chunks().slice(lo, hi - lo)))), k)
            bags += [np.unique(h[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        other = label[:, None] != label[None, :]
        if rows["i"][0].as_py() != rows["j"][0].as_py():
            other &= side[:, None] != side[None, :]
        pairs = np.array(_forest(bags, label, other, least), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])

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


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, class_id, kept.

    class_id is the smallest doc_id that links of similarity >= ``least`` reach;
    kept: whether it is this one's.  Texts of equal words (case and white space
    aside) are one class; texts without words, null ones too, are equal.  Rows
    of one doc_id are one document.  A class that has no ids has its key, which
    is negative.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = written(sketched(plain, k), "sketches")
    reps = marks.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("words").alias("words"))
    reps = reps.withColumn("node", F.coalesce("rep", F.col("c1").bitwiseOR(F.lit(-(1 << 63)))))
    # one row of each class that has an id: of several rows with the id, the same bands
    own = (marks.where("words > 0").join(reps.where("rep IS NOT NULL"), ["c1", "c2"]).where("doc_id = rep")
           .select("node", F.posexplode("bands").alias("band", "key")).select("node", "key").distinct())
    own = written(own, "bands")
    shared = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(own.join(shared, "key"), "buckets")
    rank = buckets.groupBy("node").agg(F.sum("n").alias("rank"))
    centers = (buckets.join(rank, "node").groupBy("key")
               .agg(F.max(F.struct("rank", (-F.col("node")).alias("low"))).alias("top"))
               .select("key", (-F.col("top.low")).alias("center")))
    stars = (buckets.join(centers, "key").where("node <> center")
             .select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct())
    stars = written(stars, "stars")
    links = written(verified(stars, plain, reps, least, k), "links")
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # buckets that still hold several components, in blocks
    tagged = buckets.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    split = (tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
             .where("lo < hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    spread = (tagged.join(split, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      F.col("own").alias("side")))
    blocks = (spread.join(_texts(plain, reps), "node").repartition(partitions(spark), "key", "i", "j")
              .sortWithinPartitions("key", "i", "j"))
    across = blocks.select("key", "i", "j", "side", "node", "label", "text").mapInArrow(_compared(least, k), "a long, b long")
    every = written(links.select("a", "b").unionByName(across), "all_links")
    label = components(every.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = reps.join(label, "node", "left").select("c1", "c2", F.coalesce("label", "node").alias("class_id"))
    return (marks.join(classes, ["c1", "c2"])
            .select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id") < 0).alias("kept")))


@register("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
