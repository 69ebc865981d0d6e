"""Trees grown from sums per cell instead of rows.

A cell is one combination of features: area, type and calendar day.  Its rows take the same way
through every tree, and a split by squared error needs no more of them than their
weight and their sum of labels.  So the rows are read once, sorted by cell and packed (``Cells``), and a
tree costs as much as there are cells: at most areas x types x days, however many rows.

* decision tree, boosting: one task holds the cells' sums
* forest: each row is drawn for each tree by a Poisson number, where the row lies; a tree's sums per
  cell go to the task that grows it
* AdaBoost.R2: a row's weight follows from its label and the trees so far, so each round sums up the rows'
  weights where they lie

Splits are those of Spark ML's trees: one-hot categories, midpoints between the numbers that occur, the first
of equal gains; all numbers that occur are candidates.  Where there are more than ``MAX_CELLS`` cells, a task
couldn't hold them: ``packed`` gives None then, and the caller takes Spark ML's own trees.
"""

from __future__ import annotations

import json
import math
import threading
import uuid
import zlib
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from binsight.session import ensure_checkpoint_dir

#: Cells that a task may hold, about 100 bytes each.
MAX_CELLS = 2_000_000
#: Values of all features together: the driver holds them.
MAX_VALUES = 100_000
#: Rows of a task while they are packed, and of a packed piece, whose arrays stay in a core's cache.
PART_ROWS, PIECE_ROWS = 1_000_000, 65_536
#: Sums of a node and value that are held at once while a level is split.
SPLIT_ENTRIES = 4_000_000
PACKED = "codes binary, counts binary, y binary, logw binary"
SUMS = "codes binary, w binary, s binary, least binary, most binary"
TREE = "tree int, feature binary, cut binary, child binary, value binary, most double"


@dataclass
class Encoding:
    """A cell's number: the features' places in their lists of known values, as digits."""

    categorical: list[str]
    numeric: list[str]
    values: list[list]  # per feature, sorted; a category's last place is that of unknown or no value

    @property
    def sizes(self) -> list[int]:
        return [len(v) + (i < len(self.categorical)) for i, v in enumerate(self.values)]

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """A number between two known ones belongs to the nearer, the smaller of equally near ones, as a midpoint splits them."""
        code = np.zeros(len(columns[0]), np.int64)
        for i, (column, known, size) in enumerate(zip(columns, self.values, self.sizes, strict=True)):
            if i < len(self.categorical):
                at = pc.fill_null(pc.index_in(column, pa.array(known, pa.string())), len(known)).to_numpy(zero_copy_only=False)
            else:
                v = np.array(known, np.float64)
                at = np.searchsorted((v[:-1] + v[1:]) / 2, column.to_numpy(zero_copy_only=False), "left")
            code = code * size + at
        return code

    def bins(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.values), len(codes)), np.int32)
        for i in reversed(range(len(self.values))):
            codes, out[i] = np.divmod(codes, self.sizes[i])
        return out


@dataclass
class Tree:
    """Nodes as arrays; the right child follows the left one.  A leaf is its own left child, and nothing goes right of it."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, bins: np.ndarray, n_cat: int) -> np.ndarray:
        """``bins``: a row per feature.  A category goes right at the cut, a number above it."""
        n = bins.shape[1]
        flat, each = np.ascontiguousarray(bins).ravel(), np.arange(n)
        start, child = self.feature.astype(np.int64) * n, self.child.astype(np.int64)
        cat = self.feature < n_cat
        # right are the places from ``low`` on, as many as ``span``: one comparison of unsigned numbers
        low = np.where(cat, self.cut, np.minimum(self.cut, np.iinfo(np.int32).max - 1) + 1).astype(np.int32)
        span = np.where(cat & (self.cut >= 0), 1, np.where(cat, 0, np.iinfo(np.int32).max)).astype(np.uint32)
        at = np.zeros(n, np.int64)
        for _ in range(self.depth):
            b = flat.take(start.take(at) + each)
            at = child.take(at) + ((b - low.take(at)).view(np.uint32) < span.take(at))
        return self.value.take(at)

    def row(self, tree: int = 0, most: float = 0.0) -> list:
        return [tree, *(a.tobytes() for a in (self.feature, self.cut, self.child, self.value)), most]

    @classmethod
    def of(cls, r, depth: int) -> Tree:
        kinds = (("feature", np.int16), ("cut", np.int32), ("child", np.int32), ("value", np.float64))
        return cls(*(np.frombuffer(r[name], kind) for name, kind in kinds), depth)


def grow(bins: np.ndarray, w: np.ndarray, s: np.ndarray, depth: int, sizes: list[int], n_cat: int, counted: bool = False) -> Tree:
    """A tree of least squares, level by level, from the cells' weights and weighted sums of labels.
    ``counted``: the weights are no whole numbers, so whether a side is empty is told by counting its cells."""
    mean = s.sum() / w.sum()
    s = s - w * mean
    least = 1e-13 * float((s * s / w).sum())  # gains below are rounding
    at, k, start, levels = np.zeros(len(w), np.int64), 1, 0, []
    for level in range(depth + 1):
        total_w, total_s = np.bincount(at, w, k), np.bincount(at, s, k)
        own = np.arange(start, start + k, dtype=np.int32)
        feature, cut = np.zeros(k, np.int16), np.full(k, -1 if n_cat else np.iinfo(np.int32).max, np.int32)
        gain = np.full(k, least)
        split = np.zeros(k, bool)
        step = max(SPLIT_ENTRIES // max(sizes), 1)
        for lo in range(0, k if level < depth else 0, step):
            hi = min(lo + step, k)
            some = slice(None) if hi - lo == k else np.flatnonzero((at >= lo) & (at < hi))
            a, ws, ss = at[some] - lo, w[some], s[some]
            tw, ts = total_w[lo:hi, None], total_s[lo:hi, None]
            base = ts[:, 0] ** 2 / tw[:, 0]
            for f, size in enumerate(sizes):
                key = a * size + bins[f][some]
                shape = hi - lo, size
                sums = [np.bincount(key, x, shape[0] * size).reshape(shape) for x in (ws, ss)]
                if counted:
                    sums.append(np.bincount(key, minlength=shape[0] * size).reshape(shape))
                if f >= n_cat:
                    sums = [np.cumsum(x, axis=1) for x in sums]
                one_w, one_s = (x[:, :-1] for x in sums[:2])
                if not one_w.shape[1]:
                    continue
                two_w, two_s = tw - one_w, ts - one_s
                if counted:
                    there = sums[2][:, :-1]
                    good = (there > 0) & (there < np.bincount(a, minlength=shape[0])[:, None]) & (one_w > 0) & (two_w > 0)
                else:
                    good = (one_w > 0) & (two_w > 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(good, one_s * one_s / one_w + two_s * two_s / two_w, -np.inf)
                at_best = gains.argmax(axis=1)
                best = gains[np.arange(shape[0]), at_best] - base
                better = np.flatnonzero(best > gain[lo:hi])
                gain[lo + better], feature[lo + better], cut[lo + better] = best[better], f, at_best[better]
                split[lo + better] = True
        rank = np.cumsum(split) - 1
        levels.append((feature, cut, np.where(split, start + k + 2 * rank, own).astype(np.int32), total_s / total_w + mean))
        if not split.any():
            break
        inner = split[at]
        if not inner.all():
            bins, w, s, at = bins[:, inner], w[inner], s[inner], at[inner]
        f = feature[at]
        b = bins[f, np.arange(len(at))]
        at = 2 * rank[at] + np.where(f < n_cat, b == cut[at], b > cut[at])
        start, k = start + k, 2 * int(split.sum())
    return Tree(*(np.concatenate(x) for x in zip(*levels, strict=True)), depth=len(levels) - 1)


def _arrays(batches, kinds: dict):
    """The packed rows of a task, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in kinds.items()]


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)],
                                      names=[name for name, _ in fields])


_ROWS = {"codes": np.int64, "counts": np.int64, "y": np.float64, "logw": np.float64}
_SUMS = {"codes": np.int64, "w": np.float64, "s": np.float64, "least": np.float64, "most": np.float64}


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


@dataclass
class Cells:
    """Training rows packed by cell, cached until ``drop``; each piece holds rows of some cells, sorted by cell and label."""

    encoding: Encoding
    rows: DataFrame
    n: int

    def drop(self) -> None:
        self.rows.unpersist()

    def scored(self, model: CellTrees) -> CellTrees:
        """The model with its predictions for the cells of the training rows, so that no row of theirs goes through
        its trees again; other cells do."""
        def look(batches):
            for codes, in _arrays(batches, {"codes": np.int64}):
                yield _batch([[codes.tobytes(), model.predict(codes).tobytes()]], "codes binary, p binary")

        found = self.rows.select("codes").mapInArrow(look, "codes binary, p binary").collect()  # 16 bytes a cell, at most MAX_CELLS
        codes, p = (np.concatenate([np.frombuffer(r[i], kind) for r in found]) for i, kind in enumerate((np.int64, np.float64)))
        known, first = np.unique(codes, return_index=True)
        model.known = known, p[first]
        return model

    def _task(self, sums: DataFrame, build) -> list:
        """What ``build`` makes of all cells, in one task."""
        encoding = self.encoding

        def whole(batches):
            codes, *columns = (np.concatenate(x) for x in zip(*_arrays(batches, _SUMS), strict=True))
            yield _batch(build(encoding.bins(codes), *columns), TREE)

        return sorted(sums.repartition(1).mapInArrow(whole, TREE).collect(), key=lambda r: r["tree"])

    def sums(self) -> DataFrame:
        def look(batches):
            for codes, counts, y, _ in _arrays(batches, _ROWS):
                at = _starts(counts)
                yield _batch([[x.tobytes() for x in (codes, counts.astype(np.float64), np.add.reduceat(y, at), y[at], y[at + counts - 1])]], SUMS)

        return self.rows.mapInArrow(look, SUMS)

    def tree(self, depth: int) -> CellTrees:
        sizes, n_cat = self.encoding.sizes, len(self.encoding.categorical)

        def build(bins, w, s, *_):
            return [grow(bins, w, s, depth, sizes, n_cat).row()]

        return self.scored(CellTrees(self.encoding, "mean", [Tree.of(r, depth) for r in self._task(self.sums(), build)], [1.0]))

    def boosting(self, rounds: int, depth: int, step: float) -> CellTrees:
        """Squared error, as Spark ML's boosting has it: later trees fit twice the residual and count by ``step``."""
        sizes, n_cat = self.encoding.sizes, len(self.encoding.categorical)

        def build(bins, w, s, *_):
            out, so_far = [], 0.0
            for m in range(rounds):
                tree = grow(bins, w, 2 * (s - w * so_far) if m else s, depth, sizes, n_cat)
                so_far = so_far + (step if m else 1.0) * tree.predict(bins, n_cat)
                out.append(tree.row(m))
            return out

        trees = [Tree.of(r, depth) for r in self._task(self.sums(), build)]
        return self.scored(CellTrees(self.encoding, "sum", trees, [1.0] + [step] * (len(trees) - 1)))

    def forest(self, trees: int, depth: int, seed: int) -> CellTrees:
        """Each tree has its own draw of the rows with replacement, as Poisson numbers of mean 1."""
        encoding, sizes, n_cat = self.encoding, self.encoding.sizes, len(self.encoding.categorical)
        drawn_as = "tree int, codes binary, w binary, s binary"

        def draw(batches):
            for codes, counts, y, _ in _arrays(batches, _ROWS):
                at = _starts(counts)
                piece = zlib.crc32(y.tobytes(), zlib.crc32(codes.tobytes()))  # the same draws wherever the piece lies
                for t in range(trees):
                    times = np.random.default_rng([seed, t, piece]).poisson(1.0, len(y))
                    w = np.add.reduceat(times, at)
                    there = w > 0
                    yield _batch([[t, *(x[there].tobytes() for x in (codes, w.astype(np.uint32), np.add.reduceat(times * y, at)))]], drawn_as)

        def grown(batches):
            parts = {}
            for batch in batches:
                for t, row in zip(batch.column("tree").to_pylist(), _arrays([batch], {"codes": np.int64, "w": np.uint32, "s": np.float64}), strict=True):
                    parts.setdefault(t, []).append(row)
            for t in sorted(parts):
                codes, w, s = (np.concatenate(x) for x in zip(*parts.pop(t), strict=True))
                if len(codes):  # a tree that drew no row at all is left out
                    yield _batch([grow(encoding.bins(codes), w.astype(np.float64), s, depth, sizes, n_cat).row(t)], TREE)

        drawn = self.rows.mapInArrow(draw, drawn_as).repartition(trees, "tree")
        found = sorted(drawn.mapInArrow(grown, TREE).collect(), key=lambda r: r["tree"])
        return self.scored(CellTrees(encoding, "mean", [Tree.of(r, depth) for r in found], [1.0] * len(found)))

    def adaboost(self, rounds: int, depth: int, every: int) -> CellTrees:
        """AdaBoost.R2 with linear loss (see ``models.adaboost``).  Every ``every`` rounds the rows' weights are
        cached; between, they are worked out from the trees since."""
        encoding, sizes, n_cat = self.encoding, self.encoding.sizes, len(self.encoding.categorical)

        def weights(codes, counts, y, logw, since):
            bins, logw = encoding.bins(codes), logw.copy() if len(logw) else np.zeros(len(y))
            for tree, log_beta, most in since:
                off = np.repeat(tree.predict(bins, n_cat), counts)
                np.abs(np.subtract(y, off, out=off), out=off)
                off *= -log_beta / most
                logw += off
            logw += sum(log_beta for _, log_beta, _ in since)
            return logw, bins

        def build(bins, w, s, least, most):
            some = w > 0
            tree = grow(bins[:, some], w[some], s[some], depth, sizes, n_cat, counted=True)
            p = tree.predict(bins, n_cat)
            return [tree.row(0, float(np.maximum(np.abs(least - p), np.abs(most - p)).max()))]

        def summed(since):
            def look(batches):
                for codes, counts, y, logw in _arrays(batches, _ROWS):
                    w, at = np.exp(weights(codes, counts, y, logw, since)[0]), _starts(counts)
                    yield _batch([[x.tobytes() for x in (codes, np.add.reduceat(w, at), np.add.reduceat(w * y, at), y[at], y[at + counts - 1])]], SUMS)
            return look

        def lost(since, tree):
            def look(batches):
                for codes, counts, y, logw in _arrays(batches, _ROWS):
                    logw, bins = weights(codes, counts, y, logw, since)
                    w = np.exp(logw)
                    yield _batch([[float((w * np.abs(y - np.repeat(tree.predict(bins, n_cat), counts))).sum()), float(w.sum())]], "err double, w double")
            return look

        def kept(since):
            def look(batches):
                for codes, counts, y, logw in _arrays(batches, _ROWS):
                    yield _batch([[x.tobytes() for x in (codes, counts, y, weights(codes, counts, y, logw, since)[0])]], PACKED)
            return look

        rows, since, trees, shares = self.rows, [], [], []
        try:
            for m in range(rounds):
                r = self._task(rows.mapInArrow(summed(list(since)), SUMS), build)[0]
                tree, most = Tree.of(r, depth), r["most"]
                if most <= 0.0:  # perfect fit: keep it and stop
                    trees.append(tree)
                    shares.append(1.0)
                    break
                parts = rows.mapInArrow(lost(list(since), tree), "err double, w double").collect()  # one per piece
                loss = math.fsum(p["err"] for p in parts) / (most * math.fsum(p["w"] for p in parts))
                if loss >= 0.5:
                    if not trees:  # the first tree is kept, as in the reference
                        trees.append(tree)
                        shares.append(1.0)
                    break
                beta = loss / (1.0 - loss)
                trees.append(tree)
                shares.append(math.log(1.0 / beta) if beta > 0 else 1.0)
                if beta > 0:
                    since.append((tree, math.log(beta), most))
                if (m + 1) % every == 0 and since and m + 1 < rounds:
                    before, rows = rows, rows.mapInArrow(kept(list(since)), PACKED).persist()
                    rows.count()
                    since = []
                    if before is not self.rows:
                        before.unpersist()
        finally:
            if rows is not self.rows:
                rows.unpersist()
        return self.scored(CellTrees(encoding, "median", trees, shares))


#: Predictions of cells that this Python worker has met and the training rows hadn't: model -> (cells, predictions).
_MET: dict = {}
_NONE = np.empty(0, np.int64), np.empty(0)


def _found(want: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number stands among the known ones, in order, and whether it does."""
    at = np.searchsorted(known, want)
    there = np.zeros(len(want), bool)
    inside = at < len(known)
    there[inside] = known[at[inside]] == want[inside]
    return at, there


def _predicted(model: CellTrees, codes: np.ndarray) -> np.ndarray:
    """A cell that is met first is sent through the trees, and kept; up to MAX_CELLS are."""
    want, each = np.unique(codes, return_inverse=True)
    out = np.empty(len(want))
    known, p = model.known
    at, there = _found(want, known)
    out[there] = p[at[there]]
    left = np.flatnonzero(~there)
    if len(left):
        met, p = _MET.get(model.uid, _NONE)
        at, there = _found(want[left], met)
        out[left[there]] = p[at[there]]
        left, at = left[~there], at[~there]
        if len(left):
            out[left] = model.predict(want[left])
            if sum(len(c) for c, _ in _MET.values()) + len(left) > MAX_CELLS:
                _MET.clear()
                met, p, at = *_NONE, np.zeros(len(left), np.int64)
            _MET[model.uid] = np.insert(met, at, want[left]), np.insert(p, at, out[left])
    return out[each]


@dataclass
class CellTrees:
    """Fitted trees: ``kind`` is their weighted mean, sum or median."""

    encoding: Encoding
    kind: str
    trees: list[Tree]
    weights: list[float]
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)
    known: tuple = _NONE  # cells, in order, and their predictions

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        n_cat, w = len(self.encoding.categorical), np.array(self.weights)
        for lo in range(0, len(codes), 16_384):
            bins = self.encoding.bins(codes[lo:lo + 16_384])
            if self.kind == "median":
                p = np.stack([t.predict(bins, n_cat) for t in self.trees], axis=1)
                order = np.argsort(p, axis=1, kind="stable")
                reached = np.cumsum(w[order], axis=1) >= 0.5 * w.sum()
                reached[:, -1] = True
                middle = np.take_along_axis(order, reached.argmax(axis=1)[:, None], axis=1)
                out[lo:lo + 16_384] = np.take_along_axis(p, middle, axis=1)[:, 0]
            else:
                total = np.zeros(bins.shape[1])
                for t, share in zip(self.trees, self.weights, strict=True):
                    total += share * t.predict(bins, n_cat)
                out[lo:lo + 16_384] = total / w.sum() if self.kind == "mean" else total
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``prediction``; a row without a date has none."""
        model, n_cat = self, len(self.encoding.categorical)

        @F.arrow_udf("double")
        def predicted(*columns: pa.Array) -> pa.Array:
            known = np.ones(len(columns[0]), bool)
            for c in columns[n_cat:]:
                known &= c.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(len(known))
            if known.any():
                keep = pa.array(known)
                out[known] = _predicted(model, model.encoding.codes([c.filter(keep) for c in columns]))
            return pa.array(out, pa.float64(), mask=~known)

        return df.withColumn("prediction", predicted(*_features(self.encoding.categorical, self.encoding.numeric)))

    def save(self, path: str) -> None:
        """A row per tree, and one row of what they are made of."""
        spark = SparkSession.getActiveSession()
        rows = [(*t.row(i)[:-1], w, t.depth) for i, (t, w) in enumerate(zip(self.trees, self.weights, strict=True))]
        (spark.createDataFrame(rows, TREE.replace("most double", "weight double, depth int"))
         .write.mode("overwrite").parquet(f"{path}/cell_trees"))
        about = json.dumps([self.kind, self.encoding.categorical, self.encoding.numeric, self.encoding.values])
        spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/cell_values")

    @classmethod
    def load(cls, path: str) -> CellTrees:
        spark = SparkSession.getActiveSession()
        kind, *parts = json.loads(spark.read.parquet(f"{path}/cell_values").first()["about"])
        rows = spark.read.parquet(f"{path}/cell_trees").orderBy("tree").collect()  # one per tree
        return cls(Encoding(*parts), kind, [Tree.of(r, r["depth"]) for r in rows], [r["weight"] for r in rows])


def _features(categorical, numeric) -> list:
    return [F.col(c).cast("string").alias(c) for c in categorical] + [F.col(c).cast("long").alias(c) for c in numeric]


def _pack(train: DataFrame, categorical: list[str], numeric: list[str], label: str) -> Cells | None:
    if not all(isinstance(train.schema[c].dataType, (ByteType, ShortType, IntegerType, LongType)) for c in numeric):
        return None
    ensure_checkpoint_dir(train.sparkSession)
    names = [*categorical, *numeric]
    rows = train.dropna(subset=[label, *numeric]).select(*_features(categorical, numeric), F.col(label).cast("double").alias("_y"))
    met = rows.groupBy(*names).agg(F.count("*").alias("_n")).checkpoint()
    count, n = met.agg(F.count("*"), F.sum("_n")).first()
    if not count:
        raise ValueError("no rows to fit")
    if count > MAX_CELLS:
        return None
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(names)])).alias("e")
    values = met.select(each).select("e.*").where("v IS NOT NULL").distinct().limit(MAX_VALUES + 1).collect()
    if len(values) > MAX_VALUES:  # held against the bound only: such rows are for Spark ML's trees
        return None
    known = [sorted(r["v"] for r in values if r["i"] == i) for i in range(len(categorical))]
    known += [sorted(int(r["v"]) for r in values if r["i"] == i + len(categorical)) for i in range(len(numeric))]
    encoding = Encoding(list(categorical), list(numeric), known)
    if math.prod(encoding.sizes) >= 2 ** 62:
        return None
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    # a cell of many rows is dealt over several tasks by the label
    many, salt = F.lit(False), F.lit(0)
    for r in met.where(F.col("_n") > max(PART_ROWS, n // 100)).select(*names).collect():  # at most 100
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]))
        many = many | same
        salt = F.when(many, F.pmod(F.xxhash64("_y"), F.lit(parts))).otherwise(F.lit(0))

    def pack(batches):
        found = [(encoding.codes(b.columns[:-1]), b.column("_y").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not found:
            return
        codes, y = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        if not np.isfinite(y).all():
            raise ValueError("a label is not a finite number")
        order = np.lexsort((y, codes))
        codes, y = codes[order], y[order]
        for lo in range(0, len(y), PIECE_ROWS):
            own, counts = np.unique(codes[lo:lo + PIECE_ROWS], return_counts=True)
            labels = y[lo:lo + PIECE_ROWS]
            yield _batch([[x.tobytes() for x in (own, counts.astype(np.int64), labels, np.empty(0))]], PACKED)

    packed = rows.repartition(parts, *names, salt).mapInArrow(pack, PACKED).persist()
    packed.count()
    return Cells(encoding, packed, int(n))


_SHARED: dict = {}


@contextmanager
def shared(train: DataFrame):
    """The rows are packed once for all models that are fitted to ``train`` within."""
    _SHARED[id(train)] = kept = {"lock": threading.Lock()}
    try:
        yield
    finally:
        del _SHARED[id(train)]
        for key, cells in kept.items():
            if key != "lock" and cells is not None:
                cells.drop()


@contextmanager
def packed(train: DataFrame, categorical, numeric, label: str = "label"):
    """The training rows as Cells, or None where there are too many cells."""
    kept = _SHARED.get(id(train))
    if kept is not None:
        key = (tuple(categorical), tuple(numeric), label)
        with kept["lock"]:
            if key not in kept:
                kept[key] = _pack(train, list(categorical), list(numeric), label)
        yield kept[key]
        return
    cells = _pack(train, list(categorical), list(numeric), label)
    try:
        yield cells
    finally:
        if cells is not None:
            cells.drop()
