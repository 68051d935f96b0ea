"""Filters and projections.

All of these are narrow: a filter that pushes into the Parquet scan and a
projection that prunes columns, plus at most one equi-join on a key. None
shuffles more than the join needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.ledger import Ledger


def _restrict(df: DataFrame, column: str, keys) -> DataFrame:
    """Keep rows whose ``column`` is in ``keys`` (a list or a one-column DataFrame).

    A Python list is a small literal set (``isin``, pushed to the scan); a
    DataFrame of keys is applied as a semi join, so its size is unbounded."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(column))
        return df.join(k, column, "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def account_details(ledger: Ledger, account_numbers=None) -> DataFrame:
    """Account plus holder for the given account numbers (all if None)."""
    a = _restrict(ledger.accounts, "account_number", account_numbers)
    u = ledger.users.select(F.col("id").alias("_uid"), "first_name", "last_name", "email")
    return a.join(u, a.user_id == u._uid, "inner").select(
        "id", "account_number", "balance", "status", "created_at", "first_name", "last_name", "email"
    )


def active_balance(ledger: Ledger, requested: DataFrame) -> DataFrame:
    """Balance of each requested account number among *active* accounts.

    A number with no active account is an error in the reference; here it is
    a row with ``balance`` NULL and ``error = 'account_not_found'``."""
    req = requested.select(F.col(requested.columns[0]).alias("account_number")).distinct()
    act = ledger.accounts.where(F.col("status") == "active").select("account_number", "balance")
    return req.join(act, "account_number", "left").select(
        "account_number", "balance",
        F.when(F.col("balance").isNull(), F.lit("account_not_found")).alias("error"),
    )


def history_by_type(transactions: DataFrame, kind: str = "all") -> DataFrame:
    """History kept to one type; ``all`` keeps every row."""
    if kind == "all":
        return transactions
    return transactions.where(F.col("type") == kind)


def statement_lines(transactions: DataFrame) -> DataFrame:
    """The display fields of a history line."""
    return transactions.select(
        F.col("id").alias("transaction_id"),
        X.upper_first("type").alias("type_label"),
        X.js_default("description", X.NO_DESCRIPTION).alias("description_text"),
        X.signed_display_amount("type", "amount").alias("amount_text"),
    )


def relative_dates(transactions: DataFrame, as_of: str) -> DataFrame:
    """P5: age label of each transaction seen at ``as_of``."""
    return transactions.select(
        F.col("id").alias("transaction_id"), "created_at",
        X.relative_date("created_at", X.ts_literal(as_of)).alias("age_label"),
    )


def currency_text(accounts: DataFrame) -> DataFrame:
    """Balances as en-US currency text."""
    return accounts.select("account_number", "balance", X.format_currency("balance").alias("balance_text"))


def live_users(users: DataFrame) -> DataFrame:
    """The soft-delete filter."""
    return users.where(F.col("deleted_at").isNull())


def user_scope(ledger: Ledger, user_id: int) -> DataFrame:
    """Transactions of one user's accounts only (row policy applied first)."""
    mine = ledger.accounts.where(F.col("user_id") == F.lit(user_id)).select(F.col("id").alias("account_id"))
    return ledger.transactions.join(mine, "account_id", "left_semi")


def unread_alerts(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    """Unread alerts, newest first, optionally of one severity."""
    out = alerts.where(~F.coalesce(F.col("is_read"), F.lit(False)))
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc())


def due_transfers(queue: DataFrame, as_of: str) -> DataFrame:
    """P10: pending queue rows scheduled at or before ``as_of``, oldest first."""
    return queue.where(
        (F.col("status") == "pending") & (F.col("scheduled_at") <= X.ts_literal(as_of))
    ).orderBy("scheduled_at", "id")


def active_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Sessions still active and not expired at ``as_of``."""
    return sessions.where(F.col("is_active") & (F.col("expires_at") > X.ts_literal(as_of)))
