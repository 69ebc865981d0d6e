"""Every registered query against its DuckDB oracle on sf0.001 (the driver runs sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SQL = E.oracle_sql()
SLOW = {"train_eval", "leaderboard", "best_model", "score_all_models", "score", "ensemble_summary"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    import datetime as dt

    import numpy as np
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, int) and not isinstance(v, bool):
        v = float(v)  # pandas turns integer columns with NULLs into floats
    if isinstance(v, (dt.date, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, float):
        return float(f"{v:.12g}")
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    s = E.queries()[key](spark, SF_SMALL).toPandas()
    d = duck.execute(SQL[key]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert _rows(s) == _rows(d[s.columns])


@pytest.mark.parametrize("key", sorted(set(E.queries()) - set(SQL) - SLOW))
def test_rows_only_queries_run(spark, key):
    assert E.queries()[key](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "area_avg" in df.columns
