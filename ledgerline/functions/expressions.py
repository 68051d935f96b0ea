"""Column expressions shared by the operators.

Each function returns a ``Column`` built from Spark built-ins only, so every
use stays inside whole-stage code generation; there is no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's rules).
# ---------------------------------------------------------------------------
# Table CHECK rules: email is matched case-insensitively (~*), account number with ~.
EMAIL_TABLE_RULE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
ACCOUNT_NUMBER_TABLE_RULE = r"^KB[0-9]{10,}$"
# API validation rules.
EMAIL_API_RULE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ACCOUNT_NUMBER_API_RULE = r"^KB\d+$"

CREDIT_TYPES = ("deposit", "interest", "refund")
DEBIT_TYPES = ("withdrawal", "transfer", "fee")
TRANSACTION_TYPES = ("deposit", "withdrawal", "transfer", "fee", "interest", "refund")
TRANSACTION_STATUSES = ("pending", "completed", "failed", "reversed", "cancelled")
ACCOUNT_TYPES = ("savings", "checking", "business")
ACCOUNT_STATUSES = ("active", "frozen", "closed", "pending")
SEVERITIES = ("info", "warning", "critical")
LIMIT_TYPES = ("daily_withdrawal", "daily_transfer", "single_transaction", "monthly_withdrawal")
LIMIT_PERIODS = ("daily", "weekly", "monthly", "transaction")
QUEUE_STATUSES = ("pending", "processing", "completed", "failed")

LARGE_DEPOSIT_THRESHOLD = 10000
LOW_BALANCE_THRESHOLD = 100

# Alert rules: (type, severity, title, message format).
ALERT_LARGE_DEPOSIT = ("large_transaction", "info", "Large Deposit", "A deposit of $%s was made to account %s")
ALERT_LOW_BALANCE = ("low_balance", "warning", "Low Balance Alert", "Your account %s balance is $%s")
ALERT_TRANSFER_RECEIVED = ("transfer_received", "info", "Transfer Received", "You received $%s from account %s")

# Transaction descriptions and display defaults.
TRANSFER_OUT_DESCRIPTION = "Transfer to %s: %s"
TRANSFER_IN_DESCRIPTION = "Transfer from %s: %s"
DEFAULT_DESCRIPTIONS = {"deposit": "Deposit", "withdrawal": "Withdrawal", "transfer": "Transfer"}
INITIAL_DEPOSIT_DESCRIPTION = "Initial deposit"
NO_DESCRIPTION = "No description"
DEFAULT_CLOSE_REASON = "Customer request"

# Audit actions and the entity they name.
AUDIT_BALANCE_CHANGE = "balance_change"
AUDIT_ACCOUNT_CREATED = "account_created"
AUDIT_ACCOUNT_CLOSED = "account_closed"
AUDIT_ENTITY_ACCOUNT = "account"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 ------------------------------------------------------------------------
def matches(c: str | Column, pattern: str, case_insensitive: bool = False) -> Column:
    """Regex test; ``~*`` is the ``(?i)`` form. NULL input gives NULL, as in SQL."""
    return col(c).rlike(("(?i)" if case_insensitive else "") + pattern)


def valid_email(c: str | Column, rule: str = "table") -> Column:
    if rule == "api":
        return matches(c, EMAIL_API_RULE)
    return matches(c, EMAIL_TABLE_RULE, case_insensitive=True)


def valid_account_number(c: str | Column, rule: str = "table") -> Column:
    if rule == "api":
        return matches(c, ACCOUNT_NUMBER_API_RULE)
    return matches(c, ACCOUNT_NUMBER_TABLE_RULE)


# F2 ------------------------------------------------------------------------
def js_default(c: str | Column, default) -> Column:
    """JavaScript ``x || default``: NULL and empty string both fall back."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


# F3 ------------------------------------------------------------------------
def signed_amount(type_col: str | Column = "type", amount_col: str | Column = "amount") -> Column:
    """Credits count +, debits -, anything else 0 (the reconciliation rule)."""
    t, a = col(type_col), col(amount_col)
    return F.when(t.isin(*CREDIT_TYPES), a).when(t.isin(*DEBIT_TYPES), -a).otherwise(F.lit(0).cast(MONEY))


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


# F5 ------------------------------------------------------------------------
def ts_literal(value: str) -> Column:
    """A timestamp parameter (``as_of``): never ``current_timestamp()``."""
    return F.to_timestamp(F.lit(value))


# F6 ------------------------------------------------------------------------
def monthly_interest(balance: str | Column, rate: str | Column) -> Column:
    """``ROUND(balance * rate / 12, 2)`` in exact decimals, half away from zero."""
    return F.round(col(balance) * col(rate) / F.lit(12), 2).cast(MONEY)


# F8 ------------------------------------------------------------------------
def new_account_number(as_of: Column, seq: Column) -> Column:
    """``KB`` + ``yyyyMMddHHmmss`` of the run + the batch sequence, at least 4
    digits. The reference appends a random 4-digit number; a sequence that is
    unique within the batch keeps numbers unique and replays stable."""
    s = seq.cast("string")
    return F.concat(
        F.lit("KB"), F.date_format(as_of, "yyyyMMddHHmmss"),
        F.when(F.length(s) >= 4, s).otherwise(F.lpad(s, 4, "0")),
    )


# F9 ------------------------------------------------------------------------
def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped reference derived from a hash of ``parts``.

    The reference draws random v4 UUIDs; deriving it from the request keeps a
    replayed batch from minting a second reference for the same request."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
        F.substring(h, 17, 4), F.substring(h, 21, 12),
    )


# F10 -----------------------------------------------------------------------
def json_object(**fields: Column) -> Column:
    """``jsonb_build_object`` as JSON text; a NULL member stays as ``null``."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


# F14 / P4 ------------------------------------------------------------------
def upper_first(c: str | Column) -> Column:
    """JS ``s.charAt(0).toUpperCase() + s.slice(1)``; the rest is unchanged."""
    s = col(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


# P6 ------------------------------------------------------------------------
def format_currency(c: str | Column) -> Column:
    """en-US currency text: ``$1,234.50``, ``-$12.00``."""
    x = col(c)
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(x), 2))


def signed_display_amount(type_col: str | Column, amount_col: str | Column) -> Column:
    """Statement amount: ``+`` only for deposits, ``-`` for every other type."""
    return F.concat(F.when(col(type_col) == "deposit", F.lit("+")).otherwise(F.lit("-")),
                    format_currency(amount_col))


# P5 ------------------------------------------------------------------------
def relative_date(ts: str | Column, as_of: Column) -> Column:
    """Age label of ``ts`` seen at ``as_of``.

    Whole minutes/hours/days are floored from the millisecond difference (both
    sides cut to milliseconds, as a JS ``Date`` holds them). A week or older
    shows ``MMM d``, with ``, yyyy`` only when the year differs from as_of's."""
    t = F.date_trunc("millisecond", col(ts))
    now = F.date_trunc("millisecond", as_of)
    # Zone-less stamps read as UTC (the session zone) on both sides.
    diff_ms = (F.unix_micros(now.cast("timestamp_ltz")) - F.unix_micros(t.cast("timestamp_ltz"))) / F.lit(1000)
    mins = F.floor(diff_ms / F.lit(60000)).cast("bigint")
    hours = F.floor(diff_ms / F.lit(3600000)).cast("bigint")
    days = F.floor(diff_ms / F.lit(86400000)).cast("bigint")
    return (
        F.when(mins < 1, F.lit("Just now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(F.year(t) != F.year(now), F.date_format(t, "MMM d, yyyy"))
        .otherwise(F.date_format(t, "MMM d"))
    )
