"""Document fingerprints by a threshold-scaled sketch (operator 4).

A sketch keeps every shingle hash below a fixed fraction of the hash range.
So the sketch of a union is the union of sketches, and containment can be
estimated between documents of very unequal length.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import flat, lowered, partitions, shingles, table, text_slices, words

#: One hash in SCALE is kept; a hash has BITS bits.
SCALE, BITS, SHINGLE = 8, 48, 5


def sketches(texts: list[str], scale: int = SCALE, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (in lower case) below the threshold.

    A text with shingles of which none is below it keeps its least one.  A text
    without words has an empty sketch.
    """
    out: list[np.ndarray] = []
    column = lowered(pa.array(texts, pa.large_string()))
    for lo, hi in text_slices(column):
        h, first = shingles(*words(*flat(column.slice(lo, hi - lo))), k)
        h >>= np.uint64(64 - BITS)
        below = h < np.uint64((1 << BITS) // scale)
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = h[a:b][below[a:b]]
            out.append(np.unique(own if len(own) or a == b else h[a:b].min(keepdims=True)))
    return out


def encoded(sketch: np.ndarray) -> str:
    """A sketch as text: BITS / 6 characters a hash."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:].tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).copy().view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a`` that is in ``b``; 1 for an empty ``a``."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def _above(bounds: list[int], value: Column) -> Column:
    """How many of the descending bounds are above the value (null for null), by binary search.

    The bounds are one literal of the plan, and a row takes log2 of their number of steps.
    """
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")

    def step(span, _):
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        higher = F.get(table, middle) > value
        open_ = span["lo"] < span["hi"]
        return F.struct(F.when(open_ & higher, middle + 1).otherwise(span["lo"]).alias("lo"),
                        F.when(open_ & ~higher, middle).otherwise(span["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.when(value.isNotNull(), F.aggregate(steps, start, step, lambda span: span["lo"]))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text), ranged: ``bucket``, and ``ghost`` rows that repeat the first
    row of the following bucket.

    Buckets are ranges of doc_id, highest first, null last; within a bucket
    the next document is the next row.  Only bounds and the first id of each
    bucket reach the driver.
    """
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))),
                    reverse=True) if buckets > 1 else []
    bounds = [int(b) for b in bounds]
    bucket = F.coalesce(_above(bounds, F.col("doc_id")), F.lit(len(bounds) + 1))
    rows = docs.withColumn("bucket", bucket)
    heads = [(r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("doc_id")).orderBy("bucket").collect()]
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the last bucket ends with the first row
    copies = F.array(F.struct("bucket", F.lit(False).alias("ghost")))
    if before:
        place = F.lit(None).cast("int")
        for head, to in before.items():
            place = F.when(F.col("doc_id").eqNullSafe(F.lit(head)), F.lit(to)).otherwise(place) if len(before) <= 64 else place
        if len(before) > 64:
            spots = docs.sparkSession.createDataFrame([(h, t) for h, t in before.items()], "head long, place int")
            rows = rows.join(F.broadcast(spots), rows["doc_id"].eqNullSafe(spots["head"]), "left").drop("head")
        else:
            rows = rows.withColumn("place", place)
        copies = F.when(F.col("place").isNull(), copies).otherwise(
            F.array(F.struct("bucket", F.lit(False).alias("ghost")),
                    F.struct(F.col("place").alias("bucket"), F.lit(True).alias("ghost"))))
    return rows.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.*")


def fingerprints(docs: DataFrame, scale: int = SCALE, k: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edited_in, next_in (containments in the document).

    The next document is that of the next lower doc_id (after the lowest the
    highest; null ids come after it; rows of equal ids follow each other by
    text).  Null texts count as empty.  A single document is its own next one.
    """
    buckets = buckets or 3 * partitions(docs.sparkSession)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = (with_next(plain, buckets).repartition(partitions(docs.sparkSession), "bucket")
              .sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc("text")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "edited_in", "next_in"]

    def look(batches):
        held = None  # the last row, whose next one is still to come: (bucket, id, text, sketch)
        for batch in batches:
            for lo, hi in text_slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                ids, texts, bucket, ghost = (part[c].to_pylist() for c in ("doc_id", "text", "bucket", "ghost"))
                own = sketches(texts, scale, k)
                pairs = []
                for now in zip(bucket, ids, texts, own, ghost, strict=True):
                    if held is not None and held[0] == now[0]:
                        pairs.append((held, now))
                    held = None if now[4] else now
                edited = []
                for (_, _, text, _, _), (_, _, after, _, _) in pairs:
                    n = len(text) // 3
                    edited.append(text[:len(text) - n] + after[:n])
                rows = []
                for ((_, i, text, a, _), (_, _, _, c, _)), new, b in zip(pairs, edited, sketches(edited, scale, k), strict=True):
                    rows.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), encoded(a), encoded(b),
                                 likeness(a, b), likeness(a, c), containment(b, a), containment(c, a)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return ranged.mapInArrow(look, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double, "
                                   "edited_in double, next_in double")


@register("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
