"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from panelspark.registry import QUERIES
from panelspark.sources.tables import TABLES

SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}   # other subpackages test their own
KEYS = sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(df.columns, s_rows) == _rows(d_cols, d_rows)
    # no Python UDF on the data path of any oracle-checked query
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "log_TR" in df.columns
