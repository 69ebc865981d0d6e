"""Removal of repeated byte strings by suffix arrays (operator 5).

Equal strings of LENGTH bytes have equal minimizers: the least hash among
their K-byte pieces.  A text is cut into segments, runs of window starts that
have one minimizer, and segments go to shards by it, so that equal windows
meet in one shard; equal segments are counted before they are sent.  Each
shard builds a suffix array by Larsson-Sadakane refinement, gets common
prefixes as Kasai does (a prefix that goes on from the position before is one
byte shorter), and marks windows that occur twice.  Segments of a very frequent
minimizer are cut again by the least of another hash, up to LEVELS times: equal
windows still have equal minimizers, and windows that share no more than a
common phrase part.  What is very frequent after that is spread over several
shards; their distinct windows are then merged in sorted order, where binary
search finds those that another shard has, too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import flat, mix, partitions, raw, table, text_slices, written

LENGTH, K = 400, 16
#: Bytes of text whose windows are hashed at once, and bytes of a suffix array.
STEP, SHARD_BYTES = 2 << 20, 2 << 20
#: Distinct segments (of under 800 bytes) of a minimizer in one shard.
SHARD_SEGMENTS = 8192
#: How often segments of more than that are cut again; tasks that one minimizer's rows are dealt to.
LEVELS, SPREAD = 6, 64
#: Frequent minimizers (of 8 bytes) that are sent to all tasks; more are joined.
HOT_ROWS = 100_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)
_rng = np.random.default_rng(5)
_TABLES = [_rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in _BASES]
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def eights(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each position on as a number (zeros behind the end)."""
    n = len(data)
    padded = np.append(data, np.zeros(16, np.uint8))
    out = np.empty(n, np.uint64)
    for s in range(min(8, n)):
        m = (n - s + 7) // 8
        out[s::8] = padded[s:s + 8 * m].view(">u8" if big else "<u8")
    return out


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    have = _powers.get((base, 0))
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[:1] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base, 0] = (out[0], out[1])
    return have


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int = 1) -> list[np.ndarray]:
    """64-bit hashes (one or two) of each data[start:end], wherever it lies."""
    out = []
    for base, values in list(zip(_BASES, _TABLES, strict=True))[:count]:
        up, down = _power(base, max(len(data) + 1, STEP + LENGTH))
        total = np.append(np.uint64(0), np.cumsum(values[data] * up[:len(data)], dtype=np.uint64))
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _A))
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i + width] for each whole window."""
    n = len(values)
    m = -(-n // width) * width
    blocks = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def piece_hashes(part: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position on, of the first level."""
    eight = eights(part)
    m = max(len(part) - K + 1, 0)
    return mix(eight[:m] * _A + np.append(eight[8:], np.zeros(8, np.uint64))[:m] * _B)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, level: int = 0):
    """Cuts texts of at most STEP + length bytes together (or one longer text, a part at a time).
    Each ``level`` has a hash of its own.

    Yields (text index, start in the text, window starts, minimizer, digest of the bytes).
    """
    for lo in range(0, max(len(data) - length + 1, 0), STEP):
        part = data[lo:lo + STEP + length - 1]
        h = piece_hashes(part)
        if level:
            h = mix(h + np.uint64(level) * _B)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least((h & ~np.uint64(0xFFFFFF)) | place, length - K + 1)
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        # texts are told apart by their borders in this part, as a search for each byte's text would take long
        borders = np.clip(offsets - lo, 0, len(at))
        whole = np.arange(len(at)) <= np.repeat(offsets[1:] - (lo + length), np.diff(borders))
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        new[borders[borders < len(at)]] = True
        heads = np.flatnonzero(new & whole)
        if not len(heads):
            continue
        stops = np.append(np.flatnonzero(new | ~whole), len(at))
        ends = stops[np.searchsorted(stops, heads, side="right")]
        doc = np.searchsorted(offsets, heads + lo, side="right") - 1
        yield doc, heads + lo - offsets[doc], ends - heads, h[at[heads]], *digests(part, heads, ends + length - 1)


def suffix_order(data: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``length`` bytes, and each suffix's group: those equal so far as
    ``length`` have one.  ``end``: where the segment of each position ends.  Larsson-Sadakane: after
    each round groups of one are done, and the others are refined by the ranks ``depth`` further on."""
    n = len(data)
    key = eights(data, big=True)
    order = np.argsort(key)
    begins = np.append(True, key[order[1:]] != key[order[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    slots = np.flatnonzero(~(begins & np.append(begins[1:], True))) if n else np.zeros(0, np.int64)
    # equal ones by place, so that common prefixes go on; faster than a stable sort of all
    order[slots] = np.sort(rank[order[slots]] << 32 | order[slots]) & 0xFFFFFFFF
    depth = 8
    while depth < length and len(slots):
        ahead = min(depth, length - depth)
        item = order[slots]
        there = item + ahead
        second = np.where(there < end[item], rank[np.minimum(there, n - 1)] + 1, 0)
        both = (rank[item].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(both, kind="stable")
        both, item = both[by], item[by]
        order[slots] = item
        begins = np.append(True, both[1:] != both[:-1])
        rank[item] = np.maximum.accumulate(np.where(begins, slots, 0))
        slots = slots[~(begins & np.append(begins[1:], True))]
        depth += ahead
    return order, rank


def common_prefixes(data: np.ndarray, end: np.ndarray, order: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes order[slots] with those before them in the order, within their segments.

    As in Kasai's algorithm, a suffix whose predecessor follows that of the
    suffix before needs no comparing: its prefix is one byte shorter."""
    after = np.full(len(data) + 1, -2, np.int64)  # by position: the predecessor in the order
    item, before = order[slots], order[slots - 1]
    after[item] = before
    item = np.sort(item)
    before = after[item]
    previous = after[item - 1]
    head = ~((previous == before - 1) & (previous >= 0) & (item > 0) & (end[item - 1] == end[item])
             & (end[before - 1] == end[before]))
    eight = eights(data)
    i, j = item[head], before[head]
    most = np.minimum(end[i] - i, end[j] - j)
    found = np.zeros(len(i), np.int64)
    on = np.arange(len(i))
    while len(on):
        differ = eight[np.minimum(i[on] + found[on], len(data) - 1)] ^ eight[np.minimum(j[on] + found[on], len(data) - 1)]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)
        step = np.where(differ == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) // 8)
        found[on] += step
        on = on[(differ == 0) & (found[on] < most[on])]
    found = np.minimum(found, most)
    first = np.maximum.accumulate(np.where(head, np.arange(len(item)), 0))
    prefix = found[np.cumsum(head) - 1] - (item - item[first])
    out = np.empty(len(data), np.int64)
    out[item] = prefix
    return out[order[slots]]


def repeated(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, times: np.ndarray, length: int = LENGTH):
    """Which window starts of the segments data[bounds[i]:bounds[i + 1]] begin a string that occurs twice.

    ``starts``: window starts of each segment; ``times``: its occurrences.
    Returns a mask by position, and the group of each position's window.
    """
    n = len(data)
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    window = np.arange(n) - np.repeat(bounds[:-1], sizes) < np.repeat(starts, sizes)
    order, rank = suffix_order(data, end, length)
    order = order[window[order]]  # a suffix that its segment cuts off may lie between two equal windows
    slots = np.flatnonzero(rank[order[1:]] == rank[order[:-1]]) + 1
    same = np.zeros(len(order), bool)
    if len(slots):
        same[slots] = common_prefixes(data, end, order, slots) >= length
    group = np.zeros(n, np.int64)
    group[order] = np.cumsum(~same)
    weight = np.where(window, np.repeat(times, sizes), 0)
    total = np.bincount(group, weight, n + 1)
    return window & (total[group] >= 2), group


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key: rows of one key have one text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("kid"),
                       F.xxhash64(text).alias("kh"))


def packed(rows: DataFrame) -> DataFrame:
    """keyed() rows with their texts compressed, to be sent elsewhere."""
    def squeeze(batches):
        for batch in batches:
            data, offsets = flat(batch["text"])
            codec = pa.Codec("zstd", 3)
            small = [codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["kid"], batch["kh"], pa.array(np.diff(offsets)),
                                              pa.array(small, pa.binary())], ["doc_id", "kid", "kh", "size", "packed"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(squeeze, f"doc_id {id_type}, kid long, kh long, size long, packed binary")


def unpacked(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of rows lo to hi of packed() rows, and their offsets."""
    codec, size = pa.Codec("zstd"), batch["size"].to_numpy()[lo:hi]
    whole = b"".join(codec.decompress(x.as_py(), int(n), asbytes=True) for x, n in zip(batch["packed"].slice(lo, hi - lo), size, strict=True))
    return np.frombuffer(whole, np.uint8), np.append(0, np.cumsum(size))


def _slices(batch: pa.RecordBatch, limit: int):
    ends, lo = np.cumsum(batch["size"].to_numpy()), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def _cut(batches):
    for batch in batches:
        for lo, hi in text_slices(batch["text"], STEP):
            part = batch.slice(lo, hi - lo)
            for doc, *numbers in segments(*flat(part["text"])):
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part["kid"].take(doc), part["kh"].take(doc),
                     *(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in numbers)],
                    ["kid", "kh", "at", "n", "minimizer", "digest"])


CUTS = "kid long, kh long, at long, n long, minimizer long, digest long"


CUT_NAMES = ["kid", "kh", "at", "n", "minimizer", "digest"]


def _finer(data, offsets, doc, at, n, minimizer, level: int):
    """Cuts segments (index of the text, start, windows, minimizer as int64) by the hash of ``level``;
    yields the same of the finer ones, and their digests."""
    size = n + LENGTH - 1
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + STEP, side="right")))
        first = np.append(0, ends[a:b] - before)
        take = np.arange(first[-1]) + np.repeat(offsets[doc[a:b]] + at[a:b] - first[:-1], size[a:b])
        for row, start, count, least, digest in segments(data[take], first, level=level):
            row = row + a
            yield (doc[row], at[row] + start, count, mix(least + minimizer[row].view(np.uint64) * _A).view(np.int64),
                   digest.view(np.int64))
        a = b


def _cut_batch(part: pa.RecordBatch, doc, *numbers) -> pa.RecordBatch:
    of = pa.array(doc)
    return pa.RecordBatch.from_arrays([part["kid"].take(of), part["kh"].take(of), *map(pa.array, numbers)], CUT_NAMES)


def _recut(level: int):
    """Cuts the wanted segments of packed() rows by the hash of ``level``."""
    def cut(batches):
        for batch in batches:
            for lo, hi in _slices(batch, 1 << 20):
                data, offsets = unpacked(batch, lo, hi)
                part, wanted = batch.slice(lo, hi - lo), batch["wanted"].slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.diff(wanted.offsets.to_numpy()))
                own = (wanted.flatten().field(c).to_numpy() for c in ("at", "n", "minimizer"))
                for found in _finer(data, offsets, doc, *own, level):
                    yield _cut_batch(part, *found)

    return cut


def _cut_through(frequent: list[np.ndarray]):
    """Cuts whole texts, and of each level the segments with these minimizers by the next one's hash."""
    def cut(batches):
        for batch in batches:
            for lo, hi in text_slices(batch["text"], STEP):
                part = batch.slice(lo, hi - lo)
                data, offsets = flat(part["text"])
                found = [(doc, at, n, least.view(np.int64)) for doc, at, n, least, _ in segments(data, offsets)]
                for level, hot in enumerate(frequent, 1):
                    finer = []
                    for doc, at, n, minimizer, *_ in found:
                        on = np.isin(minimizer, hot)
                        if on.any():
                            finer += _finer(data, offsets, doc[on], at[on], n[on], minimizer[on], level)
                    found = finer
                for one in found:
                    yield _cut_batch(part, *one)

    return cut


def _fetch(batches):
    for batch in batches:
        for lo, hi in _slices(batch, 1 << 20):
            data, offsets = unpacked(batch, lo, hi)
            wanted = batch["wanted"].slice(lo, hi - lo)
            counts = np.diff(wanted.offsets.to_numpy())
            rows = wanted.flatten()
            doc = np.repeat(np.arange(hi - lo), counts)
            begin = offsets[doc] + rows.field("at").to_numpy()
            size = rows.field("n").to_numpy() + LENGTH - 1
            first = np.append(0, np.cumsum(size))
            for a in range(0, len(size), 4096):
                b = min(a + 4096, len(size))
                take = np.arange(first[a], first[b]) + np.repeat(begin[a:b] - first[a:b], size[a:b])
                places = pa.py_buffer((first[a:b + 1] - first[a]).astype(np.int32))
                found = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, places, pa.py_buffer(data[take])])
                yield pa.RecordBatch.from_arrays(
                    [*(rows.field(c).slice(a, b - a) for c in ("minimizer", "salt", "split", "digest", "n", "times")), found],
                    ["minimizer", "salt", "split", "digest", "n", "times", "bytes"])


def may_repeat(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Segments (once each) that may have a window in common with another one of those given.

    All windows of a segment hold its minimizer of the first level, which is the least piece of
    the bytes that they share.  Equal windows have it in the same place, so they agree in the bytes up to
    half a window before it, or in those after it.  Segments of which neither side occurs in
    another share at most a phrase, and need no place in the suffix array.
    """
    before = (length - K + 1) // 2
    after = length - before + 1
    sides = [(np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)) for _ in range(2)]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + (STEP >> 1), side="right")) - 1)
        part, own = data[bounds[lo]:bounds[hi]], bounds[lo:hi] - bounds[lo]
        sizes = np.diff(bounds[lo:hi + 1])
        place = np.arange(len(part)) - np.repeat(own, sizes)
        core = (place >= np.repeat(starts[lo:hi], sizes) - 1) & (place <= length - K)
        h = np.append(piece_hashes(part), np.zeros(K - 1, np.uint64))[:len(part)]
        least = np.where(core, (h & ~np.uint64(0xFFFFFF)) | place.astype(np.uint64), np.iinfo(np.uint64).max)
        anchor = (np.minimum.reduceat(least, own) & np.uint64(0xFFFFFF)).astype(np.int64)
        for (hashes, has), a, z in zip(sides, (anchor - before, anchor), (anchor + K, anchor + after), strict=True):
            on = np.flatnonzero((a >= 0) & (z <= sizes))
            has[lo + on] = True
            hashes[lo + on] = digests(part, own[on] + a[on], own[on] + z[on])[0]
        lo = hi
    out = np.zeros(len(starts), bool)
    for hashes, has in sides:
        on = np.flatnonzero(has)
        _, which, count = np.unique(hashes[on], return_inverse=True, return_counts=True)
        out[on] |= count[which] > 1
    return out


def _marked(rows: pa.Table):
    """Runs of repeated windows in a shard's segments, and its distinct windows that other shards may have."""
    data, bounds = raw(rows["bytes"].cast(pa.large_binary()).combine_chunks())
    wanted = (may_repeat(data, bounds, rows["n"].to_numpy()) | (rows["times"].to_numpy() > 1)
              | rows["split"].to_numpy(zero_copy_only=False))
    if not wanted.any():
        return
    rows = rows.filter(pa.array(wanted))
    data, bounds = raw(rows["bytes"].cast(pa.large_binary()).combine_chunks())
    n, times = rows["n"].to_numpy(), rows["times"].to_numpy()
    on, group = repeated(data, bounds, n, times)
    key = [rows[c].to_numpy() for c in SEGMENT]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    heads = np.flatnonzero(on & (edge[:-1] | ~np.append(False, on)[:-1]))
    tails = np.flatnonzero(on & (edge[1:] | ~np.append(on, False)[1:]))
    seg = np.searchsorted(bounds, heads, side="right") - 1
    yield *(c[seg] for c in key), heads - bounds[seg], tails - bounds[seg], None, None, None
    split = rows["split"].to_numpy(zero_copy_only=False)
    if split.any():
        sizes = np.diff(bounds)
        window = np.arange(len(data)) - np.repeat(bounds[:-1], sizes) < np.repeat(np.where(split, n, 0), sizes)
        at = np.flatnonzero(window)
        at = at[np.unique(group[at], return_index=True)[1]]  # one of each group
        f1, f2 = digests(data, at, at + LENGTH, 2)
        seg = np.searchsorted(bounds, at, side="right") - 1
        yield *(c[seg] for c in key), at - bounds[seg], at - bounds[seg], f1.view(np.int64), f2.view(np.int64), on[at]


#: What tells segments apart: hashes of their minimizer and of all their bytes, and their length.
SEGMENT = ["minimizer", "digest", "n"]
MARK_NAMES = [*SEGMENT, "lo", "hi", "f1", "f2", "done"]
MARKS = "minimizer long, digest long, n long, lo long, hi long, f1 long, f2 long, done boolean"


def _shards(batches):
    held, size, last = [], 0, None

    def out(rows):
        for columns in _marked(pa.Table.from_batches(rows)):
            n = len(columns[0])
            if n:
                kinds = [pa.int64()] * 7 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k)
                                                  for c, k in zip(columns, kinds, strict=True)], MARK_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch["minimizer"].to_numpy(), batch["salt"].to_numpy().astype(np.int64)])
        cuts = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        lo = 0
        for hi in cuts:  # a shard takes whole groups
            group = batch.slice(lo, hi - lo)
            key = tuple(keys[:, lo])
            if key != last and size > SHARD_BYTES:
                yield from out(held)
                held, size = [], 0
            held.append(group)
            size += int(group["n"].to_numpy().sum()) + LENGTH * group.num_rows
            last, lo = key, hi
    if held:
        yield from out(held)


def _merged(batches):
    """Of windows sorted by (f1, f2), those that more than one shard has: found by binary search."""
    held = None
    names = MARK_NAMES[:5]

    def out(rows):
        key = np.stack([rows["f1"].to_numpy(), rows["f2"].to_numpy()], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
        key = key.astype(">u8").view("S16").ravel()  # in the order of (f1, f2)
        twin = np.searchsorted(key, key, side="right") - np.searchsorted(key, key, side="left") > 1
        on = twin & ~rows["done"].to_numpy(zero_copy_only=False)
        return rows.select(names).filter(pa.array(on))

    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not rows.num_rows:
            continue
        f1 = rows["f1"].to_numpy()
        cut = int(np.searchsorted(f1, f1[-1], side="left"))
        held = rows.slice(cut)
        yield from out(rows.slice(0, cut)).to_batches()
    if held is not None:
        yield from out(held).to_batches()


def _kept(batches):
    for batch in batches:
        for lo, hi in _slices(batch, STEP):
            part = batch.slice(lo, hi - lo)
            data, offsets = unpacked(batch, lo, hi)
            rows = []
            for i, found in enumerate(part["found"]):
                own = data[offsets[i]:offsets[i + 1]]
                gone = np.zeros(len(own) + 1, np.int64)
                if found.is_valid and len(found):
                    spots = found.values
                    np.add.at(gone, spots.field("lo").to_numpy(), 1)
                    np.add.at(gone, spots.field("hi").to_numpy() + LENGTH, -1)
                lost = np.cumsum(gone[:-1]) > 0
                spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
                rows.append((len(own), int(lost.sum()), spans, hashlib.sha256(own[~lost].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c) for c in zip(*rows, strict=True))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _spread():
    return F.pmod(F.hash("kid", "kh", "at"), F.lit(SPREAD))


def shared(cut: DataFrame) -> DataFrame:
    """Segments whose minimizer occurs more than once; a frequent one's rows are dealt over SPREAD tasks."""
    dealt = cut.withColumn("part", _spread())
    counts = dealt.groupBy("minimizer", "part").agg(F.count("*").alias("seen"))
    total = counts.groupBy("minimizer").agg(F.sum("seen").alias("seen"), F.collect_list("part").alias("parts"))
    often = total.where("seen > 1").select("minimizer", F.explode("parts").alias("part"))
    return dealt.join(often, ["minimizer", "part"], "left_semi").drop("part")


def distinct_segments(some: DataFrame) -> DataFrame:
    return some.groupBy(*SEGMENT).agg(F.count("*").alias("times"), F.min(F.struct("kid", "kh", "at")).alias("one"))


def candidates(plain: DataFrame) -> DataFrame:
    """Segments of keyed() rows whose windows may occur elsewhere, cut so that no minimizer has
    more than SHARD_SEGMENTS distinct ones, as far as LEVELS hashes can part them."""
    cut = written(plain.select("kid", "kh", "text").mapInArrow(_cut, CUTS), "segments")
    some = written(shared(cut), "candidates")
    frequent: list[np.ndarray] | None = []  # minimizers by level, while they are few
    for level in range(1, LEVELS + 1):
        hot = written(distinct_segments(some).groupBy("minimizer").count().where(F.col("count") > SHARD_SEGMENTS)
                      .select("minimizer"), "hot")
        rows = hot.count()
        if not rows:
            break
        if frequent is not None and rows <= HOT_ROWS:
            # texts are cut where they are read
            frequent = [*frequent, np.array([r[0] for r in hot.collect()], np.int64)]
            finer = plain.select("kid", "kh", "text").mapInArrow(_cut_through(frequent), CUTS)
            rest = some.join(F.broadcast(hot), "minimizer", "left_anti")
        else:
            frequent = None
            # under 1 / SHARD_SEGMENTS of the rows, once for each of the tasks that their segments are dealt to
            hot = hot.select("minimizer", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
            dealt = some.withColumn("part", _spread())
            # a set: a row that is repeated takes it once for each copy
            wanted = (dealt.join(hot, ["minimizer", "part"], "left_semi").groupBy("kid", "kh")
                      .agg(F.collect_set(F.struct("at", "n", "minimizer")).alias("wanted")))
            finer = (packed(plain).join(wanted, ["kid", "kh"]).select("kid", "kh", "size", "packed", "wanted")
                     .mapInArrow(_recut(level), CUTS))
            rest = dealt.join(hot, ["minimizer", "part"], "left_anti")
        some = written(rest.select(*CUT_NAMES).unionByName(shared(written(finer, "segments"))), "candidates")
    return some


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> a row per row: doc_id, n_bytes,
    n_removed, n_spans, kept_sha256.

    Bytes in any LENGTH-byte string that also starts elsewhere in the corpus are
    removed; strings don't cross rows.  Null texts count as empty; a repeated
    row is another occurrence.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    plain = keyed(docs)
    some = candidates(plain)
    distinct = distinct_segments(some)
    kinds = distinct.groupBy("minimizer").agg(F.ceil(F.count("*") / SHARD_SEGMENTS).cast("int").alias("shards"))
    sent = distinct.join(kinds, "minimizer").select(
        F.col("one.kid").alias("kid"), F.col("one.kh").alias("kh"),
        F.struct(F.col("one.at").alias("at"), "n", "minimizer", F.pmod("digest", F.col("shards")).cast("int").alias("salt"),
                 (F.col("shards") > 1).alias("split"), "digest", "times").alias("w"))
    wanted = sent.groupBy("kid", "kh").agg(F.collect_list("w").alias("wanted"))
    fetched = (packed(plain).join(wanted, ["kid", "kh"]).select("size", "packed", "wanted")
               .mapInArrow(_fetch, "minimizer long, salt int, split boolean, digest long, n long, times long, bytes binary"))
    marks = written(fetched.repartition(partitions(spark), "minimizer", "salt").sortWithinPartitions("minimizer", "salt")
                    .mapInArrow(_shards, MARKS), "marks")
    across = (marks.where("f1 IS NOT NULL").repartition(partitions(spark), "f1", "f2").sortWithinPartitions("f1", "f2")
              .mapInArrow(_merged, "minimizer long, digest long, n long, lo long, hi long"))
    runs = (marks.where("f1 IS NULL").select(*SEGMENT, "lo", "hi").unionByName(across)
            .groupBy(*SEGMENT).agg(F.collect_set(F.struct("lo", "hi")).alias("runs")))
    found = (some.join(runs, SEGMENT).select("kid", "kh", F.transform("runs", lambda r: F.struct(
        (F.col("at") + r["lo"]).alias("lo"), (F.col("at") + r["hi"]).alias("hi"))).alias("runs"))
        .groupBy("kid", "kh").agg(F.flatten(F.collect_set("runs")).alias("found")))
    return (packed(plain).join(found, ["kid", "kh"], "left").select("doc_id", "size", "packed", "found")
            .mapInArrow(_kept, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


@register("op5_substrings")
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
