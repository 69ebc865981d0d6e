"""Imports the modules that register the training-data queries, and adds the pipeline."""

import corpus_pipeline
from binsight.llm import (  # noqa: F401
    fingerprint,
    licenses,
    mixing,
    neardup,
    packing,
    periodic,
    pii,
    secrets,
    substrings,
    toxicity,
    trie,
    vectors,
    warc,
)
from binsight.llm.catalog import QUERIES, SQL

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
