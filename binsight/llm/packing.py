"""Packing token sequences by non-negative least squares (operator 8).

Every document is cut into whole windows, one piece of a multiple of ``UNIT``
tokens, and a tail of fewer than ``UNIT``.  Tails are packed into units, and
units and pieces into windows, both the same way: enumerate the combinations of
few lengths that fill a window exactly, solve for how often to repeat each one
against the histogram of lengths (non-negative least squares), round, and pack
what rounding leaves greedily, longest first.  Pieces that fill no window so are
laid in a line, longest first, and the line is cut at the windows' borders, so
that only the last window isn't full, whatever the lengths.  Only the histogram
(fewer than ``UNIT + window / UNIT`` numbers) reaches the driver.  A piece finds
its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import flat, table, text_slices, word_spans, written

WINDOW = 4096
UNIT = 128
END = 2
#: Most lengths in a combination: tails in a unit, units in a window.
TAIL_PARTS, UNIT_PARTS = 3, 6
#: Distinct words whose ids a Python worker remembers (a cache, dropped when full).
CACHE = 250_000

#: Words of letters that have one lower-case form each and that no normal form changes.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

CUT_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
PLACED_NAMES = [*CUT_NAMES[:5], "sequence_id", "offset"]

_encoders: dict[str, Encoder] = {}


def listed(words: pa.LargeStringArray) -> list[str]:
    """The words, which hold no spaces, as a list: decoded together, then split."""
    data, offsets = flat(words)
    spaced = np.full(len(data) + len(words), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = data
    return spaced.tobytes().decode().split(" ")[:-1]


_MARK, _LETTER, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_MARK[list(b".,;:!?")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LOWER[65:91] += 32


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in units that are encoded one by one: their bytes, starts and sizes, and the texts' offsets.

    Units are white-space separated words, without a mark that ends them after
    a letter (the split pattern parts the two), and in lower case if they are
    ASCII.  A word with a < stays as it is: case tells a special token from text.
    """
    data, offsets = flat(column)
    starts, ends, solid = word_spans(data, offsets)
    if not len(starts):
        return data[:0], starts, starts, offsets

    def without(mask):
        total = np.append(0, np.cumsum(mask, dtype=np.int32))
        return total[ends] == total[starts]

    usual = without(data == 60)
    ascii_ = usual & without(data >= 128)
    sizes = ends - starts
    last = ends - 1
    marked = usual & (sizes > 1) & _MARK[data[last]] & _LETTER[data[np.maximum(last - 1, 0)]]
    text = data[solid]
    text = np.where(np.repeat(ascii_, sizes), _LOWER[text], text)
    begin = np.sort(np.concatenate([starts, last[marked]]))
    end = np.sort(np.concatenate([ends, last[marked]]))
    return text, begin, end - begin, offsets


class Encoder:
    """Token ids of whole texts, white-space separated words at a time.

    For a tokenizer that splits at white space (its normaliser and its split
    pattern never look across it), the ids of a text are those of its words,
    so each distinct word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # for words of LATIN letters alone, in lower case: nothing to normalise or to split but the spaces
        self.plain = None, pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, by the tokenizer as it is."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._encoded(texts, self.whole)]

    def _encoded(self, texts: list[str], steps) -> list:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn(self, words: list[str]) -> None:
        simple = list(filter(LATIN.fullmatch, words))
        for lo in range(0, len(simple), 2_000):
            some = simple[lo:lo + 2_000]
            ids = np.array(self._encoded([" ".join(some).lower()], self.plain)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1  # a word's last id alone ends a word
            flat, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.seen.update({w: flat[a:b] for w, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)})
        others = [w for w in words if w not in self.seen]
        for lo in range(0, len(others), 2_000):
            some = others[lo:lo + 2_000]
            self.seen.update(zip(some, self.ids(some), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: none), and where each text's begin."""
        text, starts, sizes, offsets = _units(column)
        places = np.append(0, np.cumsum(sizes))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(text))
        words = words.dictionary_encode()
        distinct = listed(words.dictionary)
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        known = list(map(seen.get, distinct))
        new = [i for i, ids in enumerate(known) if ids is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            known[i] = seen[distinct[i]]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        base = np.append(0, np.cumsum(sizes))
        store = np.frombuffer(b"".join(known), dtype="<u4")
        codes = words.indices.to_numpy()
        count = sizes[codes]
        first = np.append(0, np.cumsum(count))
        at = np.arange(first[-1]) + np.repeat(base[codes] - first[:-1], count)
        return store[at], first[np.searchsorted(starts, offsets)]


def combinations(total: int, parts: int) -> list[tuple[int, ...]]:
    """Non-increasing lengths that sum to ``total``, at most ``parts`` of them."""
    out: list[tuple[int, ...]] = []

    def add(rest: int, most: int, chosen: tuple[int, ...]) -> None:
        if not rest:
            out.append(chosen)
        elif len(chosen) < parts:
            left = parts - len(chosen)
            for x in range(min(rest, most), (rest - 1) // left, -1):
                add(rest - x, x, (*chosen, x))

    add(total, total, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Least squares of ``a x = b`` with x >= 0, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0] + 10):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if not n or slope[j] <= 1e-9 * scale:
            break
        free[j] = True
        while free.any():
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            free[at[x[at] <= 1e-12 * scale]] = False
            x[~free] = 0
    return x


def solve(counts: dict[int, int], window: int, parts: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """How often to fill a window with which lengths, and how many of each length remain."""
    rest = {k: int(v) for k, v in counts.items() if v > 0}
    ways = [c for c in combinations(window, parts) if all(k in rest for k in c)]
    if not ways:
        return [], rest
    lengths = sorted(rest)
    row = {k: i for i, k in enumerate(lengths)}
    a = np.zeros((len(lengths), len(ways)))
    for j, c in enumerate(ways):
        for k in c:
            a[row[k], j] += 1
    x = nnls(a, np.array([rest[k] for k in lengths], float))
    used = []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        need = {k: ways[j].count(k) for k in ways[j]}
        times = min(int(np.rint(x[j])), *(rest[k] // m for k, m in need.items()))
        if times > 0:
            used.append((ways[j], times))
            for k, m in need.items():
                rest[k] -= m * times
    return used, {k: v for k, v in rest.items() if v}


def greedy(rest: dict[int, int], window: int, exact: bool) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Longest-first packing of what is left, as patterns with repeat counts.

    ``exact``: keep only windows that come out full; other lengths remain.
    Each pattern uses up some length, so there are no more patterns than lengths.
    """
    rest, used, stuck = dict(rest), [], {}
    while rest:
        room, pattern = window, {}
        for k in sorted(rest, reverse=True):
            if m := min(room // k, rest[k]):
                pattern[k] = m
                room -= m * k
        if exact and room:
            k = max(pattern)  # nothing fills up the longest one
            stuck[k] = rest.pop(k)
            continue
        times = min(rest[k] // m for k, m in pattern.items())
        used.append((tuple(k for k, m in pattern.items() for _ in range(m)), times))
        for k, m in pattern.items():
            rest[k] -= m * times
            if not rest[k]:
                del rest[k]
    return used, stuck


class Plan:
    """Where the r-th piece of each length goes.

    ``tails``: counts of lengths below ``unit``; ``mains``: counts of multiples
    of ``unit`` (in tokens), whole windows among them.  ``cut``: pieces that fill
    no window stand in a line and may go on in the next window; mains come
    first, so they are cut at multiples of ``unit``.  Without it they stay whole
    and leave windows unfilled.
    """

    def __init__(self, tails: dict[int, int], mains: dict[int, int], window: int = WINDOW, unit: int = UNIT,
                 cut: bool = False):
        self.window, self.unit = window, unit
        filled, rest = solve(tails, unit, TAIL_PARTS)
        more, rest = greedy(rest, unit, exact=True)
        filled += more
        units = {k // unit: v for k, v in mains.items() if v}
        made = sum(times for _, times in filled)
        self.own_units = units.get(1, 0)  # units made of tails rank behind these
        units[1] = self.own_units + made
        packed, left = solve(units, window // unit, UNIT_PARTS)
        if cut:
            more, left = greedy(left, window // unit, exact=True)
            packed += more
        self.tail_slots = self._slots(filled)
        patterns = [(tuple(k * unit for k in c), times) for c, times in packed]
        left = {k * unit: v for k, v in left.items()} | rest
        # tails in units come first in rank; those packed alone follow
        self.in_units = used = {k: sum(c.count(k) * t for c, t in filled) for k in tails}
        if not cut:
            patterns += greedy(left, window, exact=False)[0]
        self.slots = self._slots(patterns, used)
        self.line: dict[int, tuple[int, int]] = {}  # of each length: first rank, place in the line of tokens
        self.line_window, place = sum(times for _, times in patterns), 0
        for k in sorted(left, reverse=True) if cut else ():
            self.line[k] = used.get(k, 0) + sum(c.count(k) * t for c, t in patterns), place
            place += k * left[k]

    @staticmethod
    def _slots(patterns, begin: dict[int, int] | None = None) -> dict[int, np.ndarray]:
        """Of each length, per pattern: first rank, pieces a window, first window, offset."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        rank = dict(begin or {})
        window = 0
        for pattern, times in patterns:
            at = 0
            for k in sorted(set(pattern), reverse=True):
                m = pattern.count(k)
                out.setdefault(k, []).append((rank.get(k, 0), m, window, at))
                rank[k] = rank.get(k, 0) + m * times
                at += m * k
            window += times
        return {k: np.array(v, dtype=np.int64) for k, v in out.items()}

    @staticmethod
    def _find(slots: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        row = slots[np.searchsorted(slots[:, 0], rank, side="right") - 1]
        within = rank - row[:, 0]
        return row[:, 2] + within // row[:, 1], row[:, 3] + within % row[:, 1] * length

    def _outer(self, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces (or units of tails) that are laid in windows themselves."""
        window, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        lined = np.zeros(len(rank), bool)
        if length in self.line:
            first, place = self.line[length]
            lined = rank >= first
            spot = place + (rank[lined] - first) * length
            window[lined], at[lined] = self.line_window + spot // self.window, spot % self.window
        if not lined.all():
            window[~lined], at[~lined] = self._find(self.slots[length], rank[~lined], length)
        return window, at

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks.  A piece
        that is too long for the rest of its window goes on at the next one's start."""
        window, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in map(int, np.unique(length)):
            here = np.flatnonzero(length == k)
            r = rank[here]
            inner = np.zeros(len(r), bool)
            if k in self.tail_slots:
                inner = r < self.in_units[k]
                unit, within = self._find(self.tail_slots[k], r[inner], k)
                w, o = self._outer(self.own_units + unit, self.unit)
                window[here[inner]], at[here[inner]] = w, o + within
            if not inner.all():
                window[here[~inner]], at[here[~inner]] = self._outer(r[~inner], k)
        return window, at


def pieces(ids: bytes, window: int = WINDOW, unit: int = UNIT) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, length, crc32, parts) of the pieces of a document of these ids.

    ``parts`` holds what it takes to cut the piece again: the crc32 of each unit
    of a main piece, the ids of a tail, nothing of a whole window.
    """
    n = len(ids) // 4
    cuts = [*range(0, n, window), n]
    main = (n - cuts[-2]) // unit * unit
    if cuts[-2] < cuts[-2] + main < n:
        cuts.insert(-1, cuts[-2] + main)
    view = memoryview(ids)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            own = view[4 * lo:4 * hi]
            if hi - lo < unit:
                parts = bytes(own)
            elif hi - lo < window:
                parts = b"".join(zlib.crc32(own[i:i + 4 * unit]).to_bytes(4, "little") for i in range(0, len(own), 4 * unit))
            else:
                parts = b""
            yield lo, hi - lo, zlib.crc32(own), parts


def joined_crc(crcs: list[int], size: int) -> int:
    """The crc32 of strings of ``size`` bytes one after the other, from each one's.

    Appending a string to another adds (xor) to its own crc32 what the other's
    turns into over ``size`` bytes, the same for any bytes, so zeros tell it.
    """
    zeros, crc = bytes(size), 0
    nothing = zlib.crc32(zeros)
    for one in crcs:
        crc = zlib.crc32(zeros, crc) ^ nothing ^ one
    return crc


def cut_crcs(parts: bytes, length: int, at: int, unit: int = UNIT) -> tuple[int, int]:
    """crc32 of the first ``at`` ids of a piece and of its others; ``at`` is a multiple of ``unit`` in a main piece."""
    if length < unit:
        return zlib.crc32(parts[:4 * at]), zlib.crc32(parts[4 * at:])
    crcs = np.frombuffer(parts, "<u4").tolist()
    return joined_crc(crcs[:at // unit], 4 * unit), joined_crc(crcs[at // unit:], 4 * unit)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, unit: int = UNIT, end: int | None = END) -> DataFrame:
    """Packs the texts of ``docs`` (doc_id, text, any more) into windows.

    A null or empty text has the end id alone.  Repeated rows are packed each.
    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  No rows in, no rows out.
    """
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, Encoder(tokenizer_path))
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, hi in text_slices(batch["text"], 2 << 20):
                part = batch.slice(lo, hi - lo)
                ids, first = encoder.encode(part["text"])
                rows, kept = [], []
                for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
                    own = ids[a:b].tobytes() + tail
                    for start, length, crc, parts in pieces(own, window, unit):
                        k = seen[length] = seen.get(length, -1) + 1
                        rows.append((i, start, length, crc, len(own) // 4, task, k))
                        kept.append(parts)
                at, *numbers = np.array(rows, dtype=np.int64).reshape(-1, 7).T
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(at)), *map(pa.array, numbers),
                                                  pa.array(kept, pa.binary())], [*CUT_NAMES, "parts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    numbers = "start long, length long, ids_crc32 long, doc_tokens long"
    cuts = written(docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {id_type}, {numbers}, task long, nth long, parts binary"), "pieces")
    counts = cuts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # fewer than unit + window / unit lengths, whatever the corpus
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = Plan({k: v for k, v in histogram.items() if k < unit},
                {k: v for k, v in histogram.items() if k >= unit}, window, unit, cut=True)

    def place(batches):
        for batch in batches:
            start, length, crc, tokens, rank = (batch[c].to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens", "rank"))
            sequence, at = plan.place(length, rank)
            over = np.flatnonzero(at + length > window)
            own, crc, others = length.copy(), crc.copy(), np.zeros(len(over), np.int64)
            own[over] = window - at[over]
            for j, i in enumerate(over.tolist()):
                crc[i], others[j] = cut_crcs(batch["parts"][i].as_py(), int(length[i]), int(own[i]), unit)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, (start, own, crc, tokens, sequence, at))], PLACED_NAMES)
            if len(over):
                rest = start[over] + own[over], length[over] - own[over], others, tokens[over], sequence[over] + 1, 0 * over
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(over)), *map(pa.array, rest)], PLACED_NAMES)

    ranked = (cuts.join(before, ["length", "task"])
              .select(*CUT_NAMES[:5], (F.col("before") + F.col("nth")).alias("rank"), "parts"))
    return ranked.mapInArrow(place, f"doc_id {id_type}, {numbers}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
