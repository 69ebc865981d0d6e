"""Periodic runs of words (operator 11), by recursive frequency splitting.

A stretch of words that repeats a period ``times`` times holds each of its words
``times`` times.  So a word that occurs less often within a segment can't be in
such a run of it and splits it; each part is judged by its own counts, until no
word splits any more.  What is left is scanned at the lags at which windows of
at least a period's length come again.

Texts are independent, so the work is one pass over them and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import table, text_slices

LEAST_WORDS, TIMES = 24, 3
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def segments(ids: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words in which every word occurs ``times`` times or more.

    Only words that a part has lost are counted again in the largest part of a
    split, so a word is looked at a logarithmic number of times, however deep
    the splitting goes.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    places = ids[order] * n + order  # by word, then place
    todo, out = [(0, n, np.unique(ids))], []
    while todo:
        lo, hi, suspects = todo.pop()
        a, b = np.searchsorted(places, suspects * n + lo), np.searchsorted(places, suspects * n + hi)
        few = (b > a) & (b - a < times)
        if not few.any():
            out.append((lo, hi))
            continue
        size = (b - a)[few]
        at = np.repeat(a[few] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cuts = np.sort(places[at] - np.repeat(suspects[few] * n, size))
        starts, ends = np.append(lo, cuts + 1), np.append(cuts, hi)
        largest = int(np.argmax(ends - starts))
        for i in np.flatnonzero(ends - starts >= least):
            s, e = int(starts[i]), int(ends[i])
            lost = np.append(ids[lo:s], ids[e:hi]) if i == largest else ids[s:e]
            todo.append((s, e, np.unique(lost)))
    return sorted(out)


def _scanned(x: np.ndarray, lag: int, at: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Runs of period ``lag`` through the places ``at``, where the lag was seen."""
    same = np.zeros(len(x) - lag + 2, bool)
    same[1:-1] = x[:-lag] == x[lag:]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2]
    for i in np.unique(np.searchsorted(starts, at, side="right") - 1):
        length = int(ends[i] - starts[i]) + lag
        if length >= max(least, times * lag):
            yield int(starts[i]), length, lag


def lag_runs(x: np.ndarray, least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal runs of at least ``least``
    words and ``times`` periods in a segment.

    Windows of 2^j words are named by pairs of shorter windows.  A window of at
    least a run's period comes again first at that period's distance, and a run
    of three periods has room for a window of up to twice the period, so each
    run shows its smallest period as the gap of one window's neighbouring places.
    """
    names, size = x, 1
    shortest = 1 << ((2 * least // 3).bit_length() - 1)
    out = []
    while len(names):
        if size >= shortest:
            order = np.argsort(names, kind="stable")
            gap = np.diff(order)
            again = names[order[1:]] == names[order[:-1]]
            near = again & (gap <= size) & ((gap > size // 2) | (size == shortest))
            at, lags = order[:-1][near], gap[near]
            by_lag = np.argsort(lags, kind="stable")
            for group in np.split(by_lag, np.flatnonzero(np.diff(lags[by_lag])) + 1):
                if len(group):
                    out += _scanned(x, int(lags[group[0]]), at[group], least, times)
            if size >= len(x) // times or not again.any():
                break
        pairs = names[:-size] * (len(x) + 1) + names[size:] if size < len(names) else names[:0]
        names = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    return out


def word_runs(words: list[bytes], least: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among the words, by start, then period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for lo, hi in segments(ids, least, times):
        _, own = np.unique(ids[lo:hi], return_inverse=True)
        found += [(lo + s, length, q) for s, length, q in lag_runs(own, least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        depth[s + q] += 1
        depth[s + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, n_words, runs
    (array of start, length, period; by start, then period), collapsed (text without the repeats).

    Words are separated by ASCII white space.  A run is a stretch of at least
    ``least`` words and ``times`` (3 or more) smallest periods that can't be
    extended.  Null and empty texts, and texts of fewer words, have no runs.
    Repeated rows and rows without an id are rows like others.
    """
    if times < 3 or least < 3:
        raise ValueError("a run takes at least three periods and three words")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def look(batches):
        for whole in batches:
            for lo, hi in text_slices(whole["text"]):
                batch = whole.slice(lo, hi - lo)
                counts, runs, texts = [], [], []
                for text in batch["text"].cast(pa.large_string()).cast(pa.large_binary()):
                    words = (text.as_py() or b"").split()
                    own = word_runs(words, least, times)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(collapsed(words, own))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(runs, RUNS),
                     pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        look, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """Input of the query: documents (doc_id, text), every tenth one by crc32(doc_id) with its tail
    replaced by repeats of that tail's first words.  A null doc_id is left as it is."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", hashed.alias("h")).select(
        "doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.expr("h % 10 = 0"), words).alias("words"))
    cut = chosen.withColumn("n", F.coalesce(F.size("words"), F.lit(-1)))
    cut = cut.withColumn("a", F.expr("int(g % greatest(n, 1))"))
    cut = cut.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)"
    return cut.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN array_join(concat(slice(words, 1, a), {tail}), ' ') ELSE text END").alias("text"))


@register("op11_periodic")
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.expr("""aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
