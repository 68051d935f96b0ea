"""Every registered query against its SQL oracle on DuckDB (the driver's
correctness gate), at sf0.001: row count, column names, values."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest
from ledger_helpers import SF_SMALL

import __spark_entry__ as E

TABLES = ("customer", "orders", "events", "supplier")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    got = df.collect()
    rel = duck.sql(E.oracle_sql()[key])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(rel.columns, want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_deposited" in df.columns


def test_every_query_has_a_docstring_or_oracle():
    qs, oracles = E.queries(), E.oracle_sql()
    missing = [k for k, fn in qs.items() if k not in oracles and not (fn.__doc__ or "").strip()]
    assert not missing, missing
    assert os.path.exists(SF_SMALL)
