"""Sort, limit and window operators.

Defect D13: the reference pages by ``created_at DESC`` with no tie-break, and
PostgreSQL puts NULLs first in DESC order. Every page here orders by
``created_at DESC NULLS FIRST, id DESC`` so a page is well defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..schemas import MONEY
from ..sources.ledger import Ledger
from .scan import TARGET_ROWS, running_sums



def newest_first():
    return [F.col("created_at").desc_nulls_first(), F.col("id").desc()]

HISTORY_COLUMNS = ["type", "amount", "description", "status", "balance_after", "created_at", "reference_number"]


def transaction_history(ledger: Ledger, account_number: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of one account's history, newest first.

    The account side is a filter on a unique number (one row), broadcast; the
    page is a top-N (``TakeOrderedAndProject``), never a full sort."""
    a = F.broadcast(ledger.accounts.where(F.col("account_number") == account_number).select(F.col("id").alias("_aid")))
    t = ledger.transactions.join(a, ledger.transactions.account_id == a._aid, "inner")
    page = t.orderBy(*newest_first())
    if offset:
        page = page.offset(int(offset))
    return page.limit(int(limit)).select(F.col("id").alias("transaction_id"), *HISTORY_COLUMNS)


def transaction_history_all(ledger: Ledger, limit: int = 50, offset: int = 0) -> DataFrame:
    """The same page for every account at once.

    ``row_number`` filtered to ``<= offset + limit`` lets Spark insert a
    partial ``WindowGroupLimit`` before the shuffle, so each map task ships at
    most ``offset + limit`` rows per account: a hot account stays cheap."""
    w = Window.partitionBy("account_id").orderBy(*newest_first())
    ranked = ledger.transactions.select(
        "account_id", "id", *HISTORY_COLUMNS, F.row_number().over(w).alias("_rn")
    ).where(F.col("_rn") <= int(offset) + int(limit))
    if offset:
        ranked = ranked.where(F.col("_rn") > int(offset))
    a = ledger.accounts.select(F.col("id").alias("account_id"), "account_number")
    return ranked.join(a, "account_id", "inner").select(
        "account_number", F.col("id").alias("transaction_id"), *HISTORY_COLUMNS,
        F.col("_rn").cast("bigint").alias("position"),
    )


def running_balance(transactions: DataFrame, opening: DataFrame | None = None,
                    status: str | None = "completed", target_rows: int = TARGET_ROWS) -> DataFrame:
    """``balance_before`` / ``balance_after`` of each row, per account in
    (created_at, id) order, from an opening balance (0 without ``opening``,
    else its ``balance`` column keyed by ``account_id``).

    The running sum is the skew-safe chunked scan (:mod:`.scan`)."""
    t = transactions if status is None else transactions.where(F.col("status") == status)
    t = t.select("id", "account_id", "type", "amount", "created_at")
    scanned = running_sums(t, ["account_id"], ["created_at", "id"], {"_run": X.signed_amount()},
                           target_rows=target_rows)
    if opening is not None:
        o = opening.select(F.col("account_id").alias("_oid"), F.col("balance").alias("_open"))
        scanned = scanned.join(o, scanned.account_id == o._oid, "left")
        start = F.coalesce(F.col("_open"), F.lit(0))
    else:
        start = F.lit(0)
    after = (start + F.col("_run")).cast(MONEY)
    return scanned.select(
        "id", "account_id", "type", "amount", "created_at",
        (after - X.signed_amount()).cast(MONEY).alias("balance_before"),
        after.alias("balance_after"),
    )


def balance_as_of(posted: DataFrame, as_of: str) -> DataFrame:
    """Each account's balance at ``as_of``: the ``balance_after`` of its
    latest row at or before that time (ties broken by id). A map-side
    ``max_by`` keeps one candidate per account per task."""
    return (
        posted.where(F.col("created_at") <= X.ts_literal(as_of))
        .groupBy("account_id")
        .agg(F.max_by("balance_after", F.struct("created_at", "id")).alias("balance"))
    )


def audit_trail(audit_logs: DataFrame, account_id: int | None = None) -> DataFrame:
    """Audit rows (of one account, if given), newest first."""
    a = audit_logs if account_id is None else audit_logs.where(F.col("account_id") == account_id)
    return a.orderBy(*newest_first())
