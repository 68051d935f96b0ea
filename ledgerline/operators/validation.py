"""Request validation with the API's first-failure precedence.

Input is the output of :func:`ledgerline.sources.requests.read_requests`.
Output adds ``valid`` and ``reason`` (NULL when valid). One ``CASE`` chain per
request kind; no lookups, so it is a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def _blank(c: str) -> Column:
    """JavaScript falsy for a string field: missing, NULL or empty."""
    return F.col(c).isNull() | (F.col(c) == "")


def _amount_bad(field: str) -> Column:
    return ~F.col(f"{field}_is_number") | (F.col(f"{field}_value") <= 0) | F.col(f"{field}_value").isNull()


def transaction_reason() -> Column:
    """The first failure of a transaction body (NULL: none)."""
    return (
        F.when(~F.col("json_ok"), F.lit("invalid_json"))
        .when(_blank("accountNumber") | _blank("type") | ~F.col("amount_present"), F.lit("missing_fields"))
        .when(~X.valid_account_number("accountNumber", "api"), F.lit("invalid_account_number"))
        .when(_amount_bad("amount"), F.lit("invalid_amount"))
        .when(~F.col("type").isin("deposit", "withdrawal"), F.lit("invalid_type"))
    )


def validate_transaction_requests(parsed: DataFrame) -> DataFrame:
    """POST transactions: JSON, required fields, number format, amount, type."""
    return _finish(parsed, transaction_reason())


def transfer_reason() -> Column:
    """The first failure of a transfer body (NULL: none)."""
    return (
        F.when(~F.col("json_ok"), F.lit("invalid_json"))
        .when(_blank("fromAccount") | _blank("toAccount") | ~F.col("amount_present"), F.lit("missing_fields"))
        .when(~X.valid_account_number("fromAccount", "api") | ~X.valid_account_number("toAccount", "api"),
              F.lit("invalid_account_number"))
        .when(_amount_bad("amount"), F.lit("invalid_amount"))
        .when(F.col("fromAccount") == F.col("toAccount"), F.lit("same_account"))
    )


def validate_transfer_requests(parsed: DataFrame) -> DataFrame:
    """POST transfers: JSON, required fields, both number formats, amount, same account."""
    return _finish(parsed, transfer_reason())


def validate_account_requests(parsed: DataFrame) -> DataFrame:
    """POST accounts: JSON, names and email present, email format, and an
    opening deposit that, when given, is a number not below zero that the
    ledger's decimal can hold."""
    dep_given = F.col("initialDeposit_present")
    reason = (
        F.when(~F.col("json_ok"), F.lit("invalid_json"))
        .when(_blank("firstName") | _blank("lastName") | _blank("email"), F.lit("missing_fields"))
        .when(~X.valid_email("email", "api"), F.lit("invalid_email"))
        .when(dep_given & (~F.col("initialDeposit_is_number") | (F.col("initialDeposit_value") < 0)
                          | F.col("initialDeposit_value").isNull()),
              F.lit("invalid_initial_deposit"))
    )
    return _finish(parsed, reason)


def _finish(parsed: DataFrame, reason: Column) -> DataFrame:
    return parsed.select("*", reason.isNull().alias("valid"), reason.alias("reason"))
