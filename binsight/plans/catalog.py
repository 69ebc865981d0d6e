"""Registered queries: each key maps to a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the operator is expressible in SQL, the equivalent DuckDB statement
over the same physical tables (used as a correctness oracle).

Parameters such as ``as_of`` dates, user ids and periods are fixed here so the
two sides see the same inputs; every query reads the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        SPARK[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


# Fixed parameters shared by the Spark and SQL sides.
AS_OF_RECENT = "2024-01-30"      # last day of the events log
AS_OF_LONG = "2001-08-01"        # last day of the orders log
AS_OF_SIGNUPS = "1995-01-10"     # a day on which several users were created
PERIOD_1 = ("1996-01-01", "1996-12-31")
PERIOD_2 = ("1996-12-31", "1997-12-31")  # shares a boundary day with period 1
COMPARE_TYPE = "1-URGENT"        # optional waste-type filter of the custom comparison
SAMPLE_USER = 7                  # the "session user" of the per-user views
DELETE_TYPE = "5-LOW"            # predicate of the delete operator
SNAPSHOT_CUTOFF = "2024-01-15 00:00:00"

# import side-effect modules that register their queries
from binsight.plans import q_core, q_compare, q_rows, q_ingest, q_models  # noqa: E402,F401
from binsight.plans import q_state  # noqa: E402,F401  (uses the SQL of those before)
