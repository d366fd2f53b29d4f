"""Every registered query of the reference operators against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from entrofield.plans import registry

TABLES = "lineitem orders part events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    norm = lambda v: None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return cols, sorted((tuple(norm(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in registry.ORACLE:
        (ca, a), (cb, b) = plain(got), plain(con.sql(registry.ORACLE[name]).df())
        assert ca == cb and len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-5) for p, q in zip(x, y)), (x, y)


def test_entry_without_corpus_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "entrofield.llm", None)
    try:
        again = importlib.reload(entry)
        assert "e6_global_entropy" in again.queries() and not any(k.startswith("op") for k in again.queries())
        assert set(again.oracle_sql()) <= set(again.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
