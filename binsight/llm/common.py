"""Helpers shared by the training-data operators.

Texts reach numpy as the flat UTF-8 buffer of an Arrow column, so hashing runs
over whole batches at once instead of per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from binsight.session import scratch_path

#: Bytes of text hashed at once: bounds the memory of a task whatever the batch.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, dtype=np.uint64))
_LANE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: cuts the lineage,
    and every reader sees the same rows even if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in columns:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix): every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take about ``limit`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a large_string or large_binary column without nulls, and each one's offset."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offset of each text in them (null: empty)."""
    return raw(pc.fill_null(column, "").cast(pa.large_string()))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each white-space separated word, and which bytes are in words.  No word
    crosses from one text into the next."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.append(True, solid)[:-1]))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.append(solid, True)[1:])) + 1
    return starts, ends, solid


def _word_slice(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~_SPACE[data]
    before = np.zeros_like(solid)
    before[1:] = solid[:-1]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    base = starts[0]
    at = np.arange(len(data) - base) - np.repeat(starts - base, np.diff(np.append(starts, len(data))))
    values = _BYTE[data[base:]] * _POW[at & 1023]
    values[~solid[base:]] = 0
    return starts, mix(np.add.reduceat(values, starts - base))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space separated word, and the index of each text's first word."""
    n, lo = len(data), 0
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while lo < n:
        hi = min(n, lo + SLICE_BYTES)
        if hi < n:  # cut behind a space: the last one before, or else the next
            gaps = np.flatnonzero(_SPACE[data[lo:hi]])
            later = np.flatnonzero(_SPACE[data[hi:]])[:1] if not len(gaps) else gaps
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi + int(later[0]) + 1 if len(later) else n
        edge = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        at, h = _word_slice(data[lo:hi], edge)
        places.append(at + lo)
        found.append(h)
        lo = hi
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and each text's first shingle.

    A text of fewer than ``k`` words, but at least one, has one shingle of all of them.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc]
    at = np.arange(n)
    at = at[(at + k <= end) | (at == first[:-1][doc])]
    end = end[at]
    total = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(k, np.uint64))
    for j in range(k):
        total += np.where(at + j < end, padded[at + j] * _LANE[j], np.uint64(0))
    return mix(total), np.searchsorted(at, first)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def grouped(batches, keys: list[str], least: int) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables that hold whole groups: as many as it takes to reach ``least`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(whole.num_rows, bool)
        for k in keys:  # what equals the last row may go on in the next batch
            column = whole[k].to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
