"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB
oracle per operator key of the inventory.

Every query reads the test tables of ``sf_dir`` through the fixture views and
runs the library's operator over the whole of them. The oracle text starts
with the same fixture views as ``WITH`` clauses and is written independently
of the Spark code, as plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

AS_OF = fixtures.AS_OF
HISTORY_AS_OF = "1998-08-03 00:00:00"  # just after the last fixture transaction
POINT_IN_TIME = "1995-06-17 00:00:00"
PAGE_ACCOUNT = "KB0000000007"
PAGE_LIMIT, PAGE_OFFSET = 10, 5
SCOPE_USER = 42


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, oracle: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """``oracle`` follows the fixture WITH list: a SELECT, or ``, name AS (...)``
    to add more CTEs first."""
    def deco(fn):
        sql = None if oracle is None else fixtures.oracle_with(*views, recursive=recursive) + oracle
        REGISTRY[key] = Entry(fn, sql)
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str) -> fixtures.Fixture:
    return fixtures.build(spark, sf_dir)


def exact_avg_sql(sum_expr: str, count_expr: str) -> str:
    """DuckDB text for ``sum / count`` as exact decimal(19,6), rounded half away
    from zero (DuckDB's own decimal ``avg`` returns a double)."""
    cents = f"CAST(({sum_expr}) * 100 AS HUGEINT)"
    n = f"CAST(({count_expr}) AS HUGEINT)"
    q = f"(sign({cents}) * ((abs({cents}) * 20000 + {n}) // (2 * {n})))"
    return f"CAST(CAST({q} AS DECIMAL(38,0)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(19,6))"


SIGNED_SQL = """CASE WHEN type IN ('deposit','interest','refund') THEN amount
  WHEN type IN ('withdrawal','transfer','fee') THEN -amount ELSE CAST(0 AS DECIMAL(15,2)) END"""


def money_text_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs({x})))"


from . import queries_core, queries_jobs  # noqa: E402,F401  (register entries)
