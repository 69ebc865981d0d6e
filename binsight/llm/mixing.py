"""Mixing sources to target weights by Poisson replication (operator 2).

A source's repetition rate is its target share of all code points over those
it has.  How often a document is repeated is a Poisson number of that mean,
found by inverting the distribution at a number hashed from the document's id:
the same document, seed and rates always give the same copies, wherever it is
processed.  The copies are shuffled globally by a hash.  DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm.catalog import register
from binsight.llm.common import fresh, table

SEED = "mix-1"
#: A rate above STEP is the sum of several numbers of rates up to it; a number's distribution is taken up to TOP.
STEP, TOP = 16.0, 80
#: Sources (of under 1 kB each) up to which the table of rates is broadcast; beyond, both sides are salted.
BROADCAST_SOURCES, SALTS = 20_000, 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, hashed from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, rate: the mean number of copies that gives each source its target share.

    ``weights``: target weight by source; other sources get none.  None: all
    sources alike.  A document's size is its code points and one more.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
    if weights is None:
        share = F.lit(1.0)
    else:
        known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights \
            else F.create_map().cast("map<string,double>")
        share = F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))
    sizes = sizes.withColumn("share", share)
    whole = sizes.agg(F.sum("size").cast("double").alias("total"), F.sum("share").alias("shares"))  # one row
    return sizes.crossJoin(F.broadcast(whole)).select(
        "source", F.when(F.col("share") > 0, F.col("total") * F.col("share") / F.col("shares") / F.col("size"))
        .otherwise(0.0).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(X <= k) of a Poisson number for k = 0 .. TOP."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def add(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TOP)), start, add, lambda acc: acc["all"])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """A row per copy of a document: all columns of docs (doc_id, text, source,
    any more; but for columns of these names), copy_no (from 1) and mix_key, in the global random order of mix_key
    within partitions that mix_key deals out.

    A null source is a source of its own.  Rows of one doc_id and source have
    the same number of copies.  No rows in, no rows out.
    """
    spark = docs.sparkSession
    rows = docs.drop("copy_no", "mix_key")
    source, draws, below, copies, salt = (fresh(c, rows.columns) for c in ("_source", "_draws", "_below", "_copies", "_salt"))
    means = rates(docs, weights).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)))
    means = means.select(F.col("source").alias(source), F.col("draws").cast("int").alias(draws),
                         _distribution(F.col("rate") / F.col("draws")).alias(below))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        both = rows.join(F.broadcast(means), F.col("source").eqNullSafe(F.col(source)))
    else:
        means = means.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        both = rows.join(means, F.col("source").eqNullSafe(F.col(source)) & (dealt == F.col(salt)))
    numbers = F.transform(F.sequence(F.lit(0), F.col(draws) - 1),
                          lambda j: F.size(F.filter(below, lambda c: c <= uniform(F.lit(seed), j.cast("string"), own))))
    both = both.withColumn(copies, F.aggregate(numbers, F.lit(0), lambda a, n: a + n)).where(F.col(copies) > 0)
    copies = both.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy_no"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), own, F.col("copy_no").cast("string")))
    copies = copies.withColumn("mix_key", key)
    return copies.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mix_key").sortWithinPartitions("mix_key")


SQL = f"""
WITH RECURSIVE sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS total, CAST(count(*) AS DOUBLE) AS shares FROM sizes),
rates AS (SELECT source, total * 1.0 / shares / size AS rate FROM sizes, whole),
means AS (SELECT source, greatest(1, CAST(ceil(rate / {STEP}) AS BIGINT)) AS draws,
                 rate / greatest(1, CAST(ceil(rate / {STEP}) AS BIGINT)) AS mean FROM rates),
below AS (
    SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
    UNION ALL
    SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM below WHERE k < {TOP}),
lists AS (SELECT source, draws, list(c ORDER BY k) AS cs FROM below GROUP BY source, draws),
counted AS (
    SELECT d.*, list_sum(list_transform(range(0, draws), lambda j: len(list_filter(cs, lambda c: c <=
        CAST('0x' || substr(md5('{SEED}|' || j || '|' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT)
        / 4503599627370496.0)))) AS copies
    FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
copied AS (SELECT * EXCLUDE (copies), unnest(range(1, CAST(copies AS BIGINT) + 1)) AS copy_no FROM counted)
SELECT *, md5('{SEED}|order|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || copy_no) AS mix_key FROM copied
"""


@register("op2_mixing", SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).withColumn("copy_no", F.col("copy_no").cast("long"))
