"""Toxicity by averaged subword embeddings and a linear softmax (operator 3).

A text is the mean of the embeddings of its words' character n-grams (hashed
UTF-8 bytes, words in lower case with their borders); a softmax over two
classes is trained jointly with the embeddings.  A word that was never seen
shares n-grams with those that were.  As the classifier is linear in the mean,
scoring needs one number per n-gram: the difference of its two class scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import flat, lowered, table, text_slices

ORDERS = (4, 5, 6)
BUCKET_BITS, WIDTH = 20, 8
#: Bounds of the training sample: labelled rows, and code points of a text in it.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 200_000
#: An n-gram of fewer training texts is left out (it would only be learned by heart); of few texts, one in 150.
LEAST_TEXTS = 25
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.5, 11
#: Bytes of text worked on at once: some tens of them are held for each in index arrays.
STEP = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)


def grams(column: pa.Array):
    """Yields (text index, bucket) arrays of the n-grams of a column of texts, a few MB at a time."""
    data, offsets = flat(lowered(column))
    n = len(offsets) - 1
    spaced = np.full(len(data) + n + 1, 32, np.uint8)
    spaced[np.arange(len(data)) + 1 + np.repeat(np.arange(n), np.diff(offsets))] = _FOLD[data]
    begin = offsets[:-1] + np.arange(n)
    top = max(ORDERS)
    for lo in range(0, len(spaced), STEP):
        code = spaced[lo:lo + STEP + top - 1]
        size = min(STEP, len(spaced) - lo)
        gap = np.append(0, np.cumsum(code == 32))
        h, power = np.zeros(size, np.uint32), np.uint32(1)
        for j in range(top):
            here = code[j:j + size].astype(np.uint32)
            h[:len(here)] += (here + np.uint32(1)) * power
            power = np.uint32((int(power) * 0x01000193) & 0xFFFFFFFF)
            if j + 1 in ORDERS:
                m = len(code) - j  # whole grams
                at = np.arange(max(0, min(size, m)))
                # border marks only at either end, and some letters between
                at = at[gap[at + j] == gap[at + 1]]
                mixed = h[at] ^ (h[at] >> np.uint32(15)) ^ np.uint32(j * 0x9E3779B1 & 0xFFFFFFFF)
                mixed = mixed * np.uint32(0x85EBCA6B)
                yield np.searchsorted(begin, at + lo, side="right") - 1, (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def scores(column: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability that each text is toxic; a text without n-grams has that of the bias alone."""
    total, count = np.zeros(len(column)), np.zeros(len(column))
    for doc, bucket in grams(column):
        total += np.bincount(doc, weight[bucket], len(column))
        count += np.bincount(doc, minlength=len(column))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -500, 500)))


def _bags(texts: pa.Array):
    """The n-grams of each text, in order: distinct buckets and their shares."""
    for lo, hi in text_slices(texts, STEP):
        per: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
        for doc, bucket in grams(texts.slice(lo, hi - lo)):
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                per[i].append(bucket[cuts[i]:cuts[i + 1]])
        for own in per:
            ids, n = np.unique(np.concatenate(own or [np.zeros(0, np.int32)]), return_counts=True)
            yield ids, (n / max(n.sum(), 1)).astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, width: int = WIDTH, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by Adagrad; returned as a weight per n-gram and a bias."""
    rng = np.random.default_rng(SEED)
    # the texts are gone through twice, so that rare n-grams, most of all, are never held
    spread, rows = np.zeros(1 << BUCKET_BITS, np.int32), 0
    for ids, _ in _bags(texts):
        spread[ids] += 1
        rows += 1
    used = spread >= min(LEAST_TEXTS, max(2, rows // 150))
    place, size = (np.cumsum(used) - 1).astype(np.int32), int(used.sum())
    bags = [(place[ids[used[ids]]], n[used[ids]]) for ids, n in _bags(texts)]
    emb = rng.uniform(-1 / width, 1 / width, (size, width)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, width)).astype(np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    seen_e, seen_s, seen_b = np.full_like(emb, 1e-8), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs if size and 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            some = order[lo:lo + BATCH]
            ids = np.concatenate([bags[i][0] for i in some])
            part = np.concatenate([bags[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            own = emb[ids]
            mean = np.stack([np.bincount(row, own[:, d] * part, len(some)) for d in range(width)], 1).astype(np.float32)
            logit = mean @ soft.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            back = (p @ soft)[row] * part[:, None]
            g = np.stack([np.bincount(ids, back[:, d], size) for d in range(width)], 1).astype(np.float32)
            seen_e += g * g
            emb -= RATE * g / np.sqrt(seen_e)
            g = p.T @ mean
            seen_s += g * g
            soft -= RATE * 0.2 * g / np.sqrt(seen_s)
            g = p.sum(0)
            seen_b += g * g
            bias -= RATE * 0.2 * g / np.sqrt(seen_b)
    weight = np.zeros(1 << BUCKET_BITS, np.float32)  # an n-gram that was never trained says nothing
    weight[used] = emb @ (soft[1] - soft[0])
    return weight, float(bias[1] - bias[0])


def held_out(doc_id) -> F.Column:
    """Whether a row is kept out of training: crc32 of the id as text, mod 5, is 0 (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fits on at most ``rows`` labelled rows that aren't held out, chosen by a hash of the id.

    The sample is fitted in one task; 2 ** BUCKET_BITS weights come back.  No
    usable labels: weights of 0, and an even score for every text.
    """
    known = (labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
              .where(F.length(F.coalesce("text", F.lit(""))) <= TRAIN_CHARS).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
              .limit(rows).select("text", F.col("toxic").cast("int").alias("toxic")))

    def fitted(batches):
        every = pa.Table.from_batches(batches)
        if every.num_rows:
            weight, bias = fit(every["text"].cast(pa.large_string()).combine_chunks(), every["toxic"].to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])

    def whole(batches):
        some = list(batches)
        return fitted(some) if some else iter(())

    model = sample.coalesce(1).mapInArrow(whole, "weight binary, bias double").collect()
    if not model:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(model[0][0], np.float32), model[0][1]


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All columns of docs (null texts count as empty) with score (0 to 1) and predicted (1 from 0.5 on)."""
    weight, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def look(batches):
        for batch in batches:
            found = [scores(batch["text"].slice(lo, hi - lo), weight.value, bias) for lo, hi in text_slices(batch["text"], STEP)]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             [*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(look, f"{kinds}, score double, predicted int")


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
