"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.llm import mixing, neardup, packing, pii, toxicity
from binsight.llm.common import fresh, table, written
from binsight.session import configure

#: Training, signatures and token counts are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the toxicity classifier, trained on labels, predicts to be toxic."""
    configure(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the smallest id, in one row
    (one of each text, if rows share the id and have different words).

    A row without an id stays if no document with an id, and no other row
    without one that stays, has the same words.
    """
    configure(spark)
    near = written(neardup.near_duplicates(docs), "near")
    keep = written(near.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")), "keep")
    many = keep.where("rows > 1").limit(1).count()
    bare = near.where("doc_id IS NULL").limit(1).count()
    out = docs.join(keep.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    key = F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\x0B\f\r ]+", " "))))
    words = fresh("_words", docs.columns)
    if many:
        again = docs.join(keep.where("rows > 1").select("doc_id"), "doc_id", "left_semi").withColumn(words, key)
        out = out.unionByName(again.dropDuplicates(["doc_id", words]).drop(words))
    if bare:
        named = docs.where("doc_id IS NOT NULL").select(key.alias(words)).distinct()
        out = out.unionByName(docs.where("doc_id IS NULL").withColumn(words, key).dropDuplicates([words])
                              .join(named, words, "left_anti").drop(words))
    return out.select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text by its kind; n_chars follows."""
    configure(spark)
    weights = pii.train(written(pii.candidates(docs.select("doc_id", "text")), "pii"))
    clean = pii.redacted(docs, weights)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources have the same share; a copy is a row."""
    configure(spark)
    return mixing.mixed(docs).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of up to 4096 tokens; a row per piece."""
    configure(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", clean_documents),
    ("near_duplicates", distinct_documents),
    ("personal_data", without_personal_data),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
