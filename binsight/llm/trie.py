"""Prefix trie of conversations in minimal perfect hash tables (operator 12).

A node is a distinct sequence of first turns, named by a digest of it: the
exclusive or of its turns' digests salted with their places, so a long
conversation's prefixes can be made in pieces.  Equal conversations are one
from the start.  A node below which little hangs is worked out in a shard with
everything below: the shard's digests get slots of a minimal perfect hash table,
counts are scattered into flat arrays over the slots, and sums go up through the
slots of the parents, deepest nodes first.  The nodes above the shards, of which
there are few or which form long chains, pass sums on to ancestors at doubled
distance in each round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import grouped, mix, partitions, table, written

#: Rows (a turn of one of the distinct conversations) below a node up to which it is worked out in one shard.
SHARD_ROWS = 50_000
#: Ids joined to one piece of text before a node's are hashed in order.
CHUNK_IDS = 10_000
KEY = ["depth", "x", "y"]


# --- turns ---------------------------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest of role and text, words: what the trie needs of each turn.

    Rows without a conv_id belong to no conversation.  Null role and text count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _running(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (conv_id, x, y, more), with ``at``, the row's place in its conversation by ``order``
    (from 1), and x and y replaced by the exclusive or of the rows up to it.

    Rows are dealt out by ranges, so a conversation of any length is split.  A task
    works out its own rows and adds one that says where its last conversation
    stands at its end; those few rows carry on into the ranges after it.
    """
    spark = rows.sparkSession
    schema = rows.schema

    def look(batches):
        conv, at, x, y = None, 0, np.int64(0), np.int64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["conv_id"].to_numpy(zero_copy_only=False)
            first = np.append(True, ids[1:] != ids[:-1])
            first[0] = conv is None or ids[0] != conv
            begin = np.maximum.accumulate(np.where(first, np.arange(len(ids)), -1))
            carried = begin < 0
            places = np.arange(len(ids)) - np.maximum(begin, 0) + 1 + np.where(carried, at, 0)
            out = {}
            for name, before in (("x", x), ("y", y)):
                upto = np.bitwise_xor.accumulate(batch[name].to_numpy(zero_copy_only=False))
                own = np.where(begin > 0, upto[np.maximum(begin, 1) - 1], 0)
                out[name] = upto ^ np.where(carried, before, own)
            conv, at, x, y = ids[-1], int(places[-1]), out["x"][-1], out["y"][-1]
            columns = [pa.array(out[c], pa.int64()) if c in out else batch[c] for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), pa.array([False] * len(ids))],
                                             [*batch.schema.names, "at", "ends"])
        if conv is not None:
            last = {"conv_id": conv, "x": int(x), "y": int(y)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([last.get(c)], batch.schema.field(c).type) for c in batch.schema.names]
                + [pa.array([at], pa.int64()), pa.array([True])], [*batch.schema.names, "at", "ends"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    parts = written(ranged.mapInArrow(look, f"{columns}, at long, ends boolean").withColumn("pid", F.spark_partition_id()), "ranges")
    # one row per range: at most as many as shuffle partitions
    upto = W.partitionBy("conv_id").orderBy("pid")
    carry = parts.where("ends").select(
        F.col("conv_id").alias("c"), F.col("pid").alias("p"), F.lead("pid").over(upto).alias("next"), F.sum("at").over(upto).alias("n"),
        F.expr("bit_xor(x) OVER (PARTITION BY conv_id ORDER BY pid)").alias("cx"),
        F.expr("bit_xor(y) OVER (PARTITION BY conv_id ORDER BY pid)").alias("cy"))
    on = (F.col("conv_id") == F.col("c")) & (F.col("pid") > F.col("p")) & (F.col("next").isNull() | (F.col("pid") <= F.col("next")))
    return parts.where("NOT ends").join(F.broadcast(carry), on, "left").select(
        *[F.expr(f"{c} ^ coalesce(c{c}, 0L)").alias(c) if c in ("x", "y") else c for c in schema.names],
        (F.col("at") + F.coalesce("n", F.lit(0))).alias("at"))


def placed(rows: DataFrame) -> DataFrame:
    """turns -> conv_id, place (from 1), digest, words: by turn (null first), then role, then digest."""
    blank = rows.withColumn("x", F.lit(0).cast("long")).withColumn("y", F.lit(0).cast("long"))
    return _running(blank, ["conv_id", "turn", "role", "digest"]).select("conv_id", F.col("at").alias("place"), "digest", "words")


def rebuilt(rows: DataFrame) -> DataFrame:
    """Input of the query: each conversation c begins with the first h places of conversation
    c - c % 20, and goes on with its own after its first h; h = crc32(c) % 4."""
    kept = F.expr("int(crc32(cast(conv_id AS string)) % 4)")
    own = rows.withColumn("h", kept)
    heads = rows.where("conv_id % 20 = 0 AND place <= 3")
    sizes = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    # every conversation has a row of place 1
    begun = (own.where("place = 1 AND h > 0").select("conv_id", "h", base.alias("base"))
             .join(heads.select(F.col("conv_id").alias("base"), "place", "digest", "words"), "base").where("place <= h"))
    rest = own.where("place > h").withColumn("base", base).join(sizes, "base", "left").select(
        "conv_id", (F.col("place") - F.col("h") + F.least(F.col("h"), F.coalesce("n", F.lit(0)))).alias("place"), "digest", "words")
    return begun.select("conv_id", "place", "digest", "words").unionByName(rest)


# --- minimal perfect hash -------------------------------------------------------------------------

class SlotTable:
    """A minimal perfect hash over distinct pairs of 64-bit numbers: n keys have the slots 0 .. n - 1.

    Level by level, keys that are alone in their bit of a bit field keep it, the
    others go on to the next, smaller field; a key's slot is the number of bits set
    before its own.  The keys are kept by slot, so a look-up of an unknown
    key, or of one whose digest another key has, is told from a hit.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.fields: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        left, done = np.arange(len(x)), 0
        while len(left):
            at = self._bit(x[left], y[left], len(self.fields), 2 * len(left))
            field = np.bincount(at, minlength=2 * len(left)) == 1
            self.fields.append(field)
            self.before.append(done + np.cumsum(field) - field)
            done += int(field.sum())
            left = left[~field[at]]
        self.x, self.y = np.zeros(done, np.int64), np.zeros(done, np.int64)
        slots = self._slots(x, y)
        self.x[slots], self.y[slots] = x, y

    @staticmethod
    def _bit(x, y, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix(mix(x.view(np.uint64) ^ seed) + y.view(np.uint64)) % np.uint64(size)).astype(np.int64)

    def _slots(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1)
        left = np.arange(len(x))
        for level, (field, before) in enumerate(zip(self.fields, self.before, strict=True)):
            at = self._bit(x[left], y[left], level, len(field))
            hit = field[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that are not in the table."""
        if not len(self.x):
            return np.full(len(x), -1)
        slots = self._slots(x, y)
        return np.where((slots >= 0) & (self.x[slots] == x) & (self.y[slots] == y), slots, -1)


def shard_nodes(depth, x, y, px, py, conv, members, words) -> dict[str, np.ndarray]:
    """Nodes of whole subtrees from their rows (a row: a distinct conversation's turn): flat arrays over slots."""
    order = np.lexsort((y, x))
    new = np.append(True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))
    one = order[new]  # enumerates the distinct digests
    slots = SlotTable(x[one], y[one])
    n = len(one)
    slot = slots.find(x, y)
    out = {k: np.zeros(n, np.int64) for k in ("depth", "px", "py", "words", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    for k, v in (("depth", depth), ("px", px), ("py", py), ("words", words)):
        out[k][slot] = v
        if (out[k][slot] != v).any():
            raise ValueError("two different prefixes have one digest")
    out["x"], out["y"] = slots.x, slots.y
    out["conv_id"] = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(out["conv_id"], slot, conv)
    np.add.at(out["n_convs"], slot, members)
    parent = slots.find(out["px"], out["py"])
    below = parent >= 0
    np.add.at(out["n_children"], parent[below], 1)
    out["n_leaves"] = (out["n_children"] == 0).astype(np.int64)
    out["saved_tokens"] = (out["n_convs"] - 1) * out["words"]
    by_depth = np.argsort(out["depth"], kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(out["depth"][by_depth])) + 1)
    for level in reversed(levels):
        level = level[below[level]]
        for k in ("n_leaves", "saved_tokens"):
            np.add.at(out[k], parent[level], out[k][level])
    out["parent_conv_id"] = np.where(below, out["conv_id"][parent], -1)
    out["top"] = ~below
    return out


# --- the trie ---------------------------------------------------------------------------------------

def _end_hashes(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the ids that end at a node.  The hash has to see a node's ids in their order:
    many tasks sort them and join them to pieces, and one task reads a node's pieces in turn."""
    n = partitions(ends.sparkSession)
    cols = [*KEY, "conv_id"]

    def pieces(batches):
        for t in grouped(batches, cols, CHUNK_IDS):
            depth, x, y, ids = (t[c].to_numpy() for c in cols)
            new = np.append(True, (np.diff(depth) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))
            lo = np.flatnonzero(new)
            text = [",".join(map(str, part.tolist())) for part in np.split(ids, lo[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(depth[lo]), pa.array(x[lo]), pa.array(y[lo]), pa.array(ids[lo]), pa.array(text)],
                                             [*cols, "ids"])

    def hashed(batches):
        now, sha = None, None
        for batch in batches:
            rows = {c: [] for c in (*KEY, "ends_sha256")}
            for *key, ids in zip(*(batch[c].to_pylist() for c in (*KEY, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        for c, v in zip(rows, (*now, sha.hexdigest()), strict=True):
                            rows[c].append(v)
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield _batch(rows)
        if now is not None:
            yield _batch({c: [v] for c, v in zip((*KEY, "ends_sha256"), (*now, sha.hexdigest()), strict=True)})

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c == "ends_sha256" else pa.int64()) for c, v in rows.items()], list(rows))

    key = "depth long, x long, y long"
    joined = (ends.select(*cols).repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .mapInArrow(pieces, f"{key}, conv_id long, ids string"))
    return joined.repartition(n, *KEY).sortWithinPartitions(*cols).mapInArrow(hashed, f"{key}, ends_sha256 string")


_NODE = ("depth", "x", "y", "px", "py", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _sharded(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Nodes of the subtrees of rows (rx, ry: the digest of a subtree's first node)."""
    names = ["depth", "x", "y", "px", "py", "conv_id", "members", "words"]

    def look(batches):
        for t in grouped(batches, ["rx", "ry"], shard_rows):
            out = shard_nodes(*(t[c].to_numpy() for c in names))
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in (*_NODE, "top")], [*_NODE, "top"])

    return (rows.select("rx", "ry", *names).repartition(partitions(rows.sparkSession), "rx", "ry").sortWithinPartitions("rx", "ry")
            .mapInArrow(look, ", ".join(f"{c} long" for c in _NODE) + ", top boolean"))


def _summed(top: DataFrame) -> DataFrame:
    """top (KEY, px, py, n_leaves, saved_tokens of the node alone) with the sums of all nodes of top below added.

    In round k a node adds what those 2^k below have gathered, so a chain of any length takes
    a number of rounds that is the logarithm of its length.
    """
    deepest = top.agg(F.max("depth")).first()[0] or 0
    state = top.withColumns({"ax": F.col("px"), "ay": F.col("py")})
    step = 1
    while step <= deepest:
        up = (state.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("ax").alias("x"), F.col("ay").alias("y"))
              .agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")))
        further = state.select((F.col("depth") + step).alias("depth"), F.col("x").alias("ax"), F.col("y").alias("ay"),
                               F.col("ax").alias("nx"), F.col("ay").alias("ny"))
        state = written(
            state.join(up, KEY, "left").join(further, ["depth", "ax", "ay"], "left").select(
                *[c for c in top.columns if c not in ("n_leaves", "saved_tokens")],
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
                F.col("nx").alias("ax"), F.col("ny").alias("ay")), "sums")
        step *= 2
    return state.select(*top.columns)


def nodes(rows: DataFrame, ids: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Trie of conversations: rows (conv_id, place from 1 without gaps, digest, words) and ids (conv_id:
    all conversations, those without rows, too) -> a row per node as ``prefix_trie`` has them."""
    salted = rows.select("conv_id", F.col("place").cast("long").alias("depth"), "digest", "words",
                         F.xxhash64("digest", "place").alias("x"), F.xxhash64("place", "digest", F.lit(1)).alias("y"))
    chained = _running(salted.withColumns({"ox": F.col("x"), "oy": F.col("y")}), ["conv_id", "depth"]).drop("digest", "at")
    last = chained.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x", "y"), "depth").alias("e")).select("conv_id", "e.*")
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in KEY]
    ends = written(ids.select("conv_id").distinct().join(last, "conv_id", "left").select("conv_id", *none), "ends")

    # equal conversations are one: the smallest id stands for all
    classes = ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members"))
    classes = classes.select("conv_id", "members", F.col("depth").alias("size"))
    paths = written(chained.join(classes, "conv_id").select(
        "conv_id", *KEY, F.expr("x ^ ox").alias("px"), F.expr("y ^ oy").alias("py"), "words", "members", "size"), "paths")
    below = paths.groupBy(*KEY).agg(F.sum(F.col("size") - F.col("depth") + 1).alias("below"))
    high = written(below.where(F.col("below") > shard_rows).select(*KEY), "high")
    low = paths.join(high, KEY, "left_anti")
    roots = low.groupBy("conv_id").agg(F.min_by(F.struct("x", "y"), "depth").alias("r")).select(
        "conv_id", F.col("r.x").alias("rx"), F.col("r.y").alias("ry"))
    shards = written(_sharded(low.join(roots, "conv_id"), shard_rows), "shards")

    one = F.struct("px", "py", "words")
    same = F.when(F.min(one) == F.max(one), F.min(one)).otherwise(F.raise_error(F.lit("two different prefixes have one digest")))
    top = paths.join(high, KEY, "left_semi").groupBy(*KEY).agg(
        same.alias("o"), F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs")).select(*KEY, "o.*", "conv_id", "n_convs")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in (*KEY, "px", "py", "words")], "conv_id", "n_convs")
    top = written(top.unionByName(root), "top")
    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    hung = (shards.where("top").select(*up, "n_leaves", "saved_tokens", F.lit(1).alias("child"))
            .unionByName(top.where("depth > 0").select(*up, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                                                       F.lit(1).alias("child")))
            .groupBy(*KEY).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.sum("child").alias("n_children")))
    valued = top.join(hung, KEY, "left").select(
        *KEY, "px", "py", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("l", F.lit(0)).alias("l"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
    valued = valued.withColumn("n_leaves", F.col("l") + F.when(F.col("n_children") == 0, 1).otherwise(0)).drop("l")
    summed = _summed(written(valued, "valued"))

    above = top.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    fields = [c for c in _NODE if c != "parent_conv_id"]
    hanging = shards.where("top").select(*fields).unionByName(summed.select(*fields)).join(above, ["depth", "px", "py"], "left")
    every = shards.where("NOT top").select(*_NODE).unionByName(hanging.select(*_NODE))
    return every.join(_end_hashes(ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conversations (conv_id, turn, role, text, any more) -> a row per node: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A conversation is its rows by turn (null first), equal turns by role, then by the MD5
    of role and text; repeated rows are turns of their own.  Null role and text
    count as empty.  Rows without a conv_id belong to no conversation; no
    conversations, no nodes.  conv_id has to be of an integer type.
    """
    if conversations.schema["conv_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("conv_id has to be of an integer type")
    rows = placed(turns(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))))
    return nodes(rows, rows.where("place = 1"), shard_rows)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(c) + 1), lambda i: ord(substr(c, i, 1))::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda p, q: xor(p >> 1, (p & 1) * 3988292384))), 4294967295::BIGINT)"""

SQL = f"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h
          FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM own)),
heads AS (SELECT c.conv_id, o.place, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h),
sizes AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
rebuilt AS (SELECT * FROM heads UNION ALL
    SELECT o.conv_id, o.place - c.h + coalesce(s.n, 0), o.digest, o.words
    FROM own o JOIN convs c USING (conv_id) LEFT JOIN sizes s USING (conv_id) WHERE o.place > c.h),
prefixes AS MATERIALIZED (
    SELECT conv_id, place AS depth, words, md5(path) AS key, coalesce(md5(lag(path) OVER (PARTITION BY conv_id ORDER BY place)), '') AS parent
    FROM (SELECT *, string_agg(digest, ',' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place) AS path FROM rebuilt)
    UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
nodes AS MATERIALIZED (
    SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved
    FROM prefixes GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT a.key, sum(n.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
          FROM nodes n LEFT JOIN children c ON c.key = n.key JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key),
ends AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS hash
         FROM (SELECT conv_id, max_by(key, depth) AS key FROM prefixes GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.hash, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (key) LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key LEFT JOIN ends e ON e.key = n.key
"""


@register("op12_trie", SQL)
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(placed(turns(table(spark, sf_dir, "conversations"))), "turns")
    return nodes(rebuilt(own), own.where("place = 1"))
