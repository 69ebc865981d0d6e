"""Driver contract: every oracle has a query, every query is callable."""

import __spark_entry__ as E


def test_oracle_keys_have_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert all(callable(f) for f in q.values())
    assert all(isinstance(v, str) and v.strip() for v in s.values())
    assert "score_benchmark" in s  # the flagship is value-checked
