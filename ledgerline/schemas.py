"""Typed schemas of the eight ledger tables and of the request frames.

One column list per table drives three things: the Spark ``StructType`` used for
typed reads, the conforming of partial inputs (missing columns become typed
NULLs) and the DuckDB spelling used by the SQL oracles.

Type rules: every integer key is ``bigint``; money is ``decimal(15,2)``; rates
are ``decimal(5,4)``; UUID, INET and JSONB columns are strings (JSON text at
rest); timestamps follow the session's ``spark.sql.timestampType``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
RATE = T.DecimalType(5, 4)

# (name, spark type, DuckDB type)
_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DateType()
_TS = "timestamp"  # resolved against the session default (NTZ in our jobs)

TABLES: dict[str, list[tuple[str, object, str]]] = {
    "users": [
        ("id", _L, "BIGINT"), ("first_name", _S, "VARCHAR"), ("last_name", _S, "VARCHAR"),
        ("email", _S, "VARCHAR"), ("phone", _S, "VARCHAR"), ("date_of_birth", _D, "DATE"),
        ("address", _S, "VARCHAR"), ("city", _S, "VARCHAR"), ("state", _S, "VARCHAR"),
        ("zip_code", _S, "VARCHAR"), ("country", _S, "VARCHAR"), ("created_at", _TS, "TIMESTAMP"),
        ("updated_at", _TS, "TIMESTAMP"), ("deleted_at", _TS, "TIMESTAMP"),
    ],
    "accounts": [
        ("id", _L, "BIGINT"), ("user_id", _L, "BIGINT"), ("account_number", _S, "VARCHAR"),
        ("account_type", _S, "VARCHAR"), ("balance", MONEY, "DECIMAL(15,2)"), ("currency", _S, "VARCHAR"),
        ("status", _S, "VARCHAR"), ("overdraft_limit", MONEY, "DECIMAL(15,2)"),
        ("interest_rate", RATE, "DECIMAL(5,4)"), ("created_at", _TS, "TIMESTAMP"),
        ("updated_at", _TS, "TIMESTAMP"), ("closed_at", _TS, "TIMESTAMP"),
        ("last_transaction_at", _TS, "TIMESTAMP"),
    ],
    "transactions": [
        ("id", _L, "BIGINT"), ("account_id", _L, "BIGINT"), ("type", _S, "VARCHAR"),
        ("amount", MONEY, "DECIMAL(15,2)"), ("balance_before", MONEY, "DECIMAL(15,2)"),
        ("balance_after", MONEY, "DECIMAL(15,2)"), ("description", _S, "VARCHAR"),
        ("reference_number", _S, "VARCHAR"), ("status", _S, "VARCHAR"),
        ("related_transaction_id", _L, "BIGINT"), ("related_account_id", _L, "BIGINT"),
        ("metadata", _S, "VARCHAR"), ("ip_address", _S, "VARCHAR"), ("user_agent", _S, "VARCHAR"),
        ("created_at", _TS, "TIMESTAMP"), ("completed_at", _TS, "TIMESTAMP"),
        ("failed_at", _TS, "TIMESTAMP"), ("failure_reason", _S, "VARCHAR"),
        ("transfer_ref", _S, "VARCHAR"),
    ],
    "audit_logs": [
        ("id", _L, "BIGINT"), ("user_id", _L, "BIGINT"), ("account_id", _L, "BIGINT"),
        ("transaction_id", _L, "BIGINT"), ("action", _S, "VARCHAR"), ("entity_type", _S, "VARCHAR"),
        ("entity_id", _L, "BIGINT"), ("old_values", _S, "VARCHAR"), ("new_values", _S, "VARCHAR"),
        ("ip_address", _S, "VARCHAR"), ("user_agent", _S, "VARCHAR"), ("session_id", _S, "VARCHAR"),
        ("created_at", _TS, "TIMESTAMP"), ("metadata", _S, "VARCHAR"),
    ],
    "sessions": [
        ("id", _S, "VARCHAR"), ("user_id", _L, "BIGINT"), ("token_hash", _S, "VARCHAR"),
        ("device_info", _S, "VARCHAR"), ("ip_address", _S, "VARCHAR"), ("user_agent", _S, "VARCHAR"),
        ("expires_at", _TS, "TIMESTAMP"), ("created_at", _TS, "TIMESTAMP"),
        ("last_activity", _TS, "TIMESTAMP"), ("is_active", _B, "BOOLEAN"),
    ],
    "alerts": [
        ("id", _L, "BIGINT"), ("user_id", _L, "BIGINT"), ("account_id", _L, "BIGINT"),
        ("transaction_id", _L, "BIGINT"), ("type", _S, "VARCHAR"), ("severity", _S, "VARCHAR"),
        ("title", _S, "VARCHAR"), ("message", _S, "VARCHAR"), ("is_read", _B, "BOOLEAN"),
        ("read_at", _TS, "TIMESTAMP"), ("created_at", _TS, "TIMESTAMP"), ("metadata", _S, "VARCHAR"),
    ],
    "account_limits": [
        ("id", _L, "BIGINT"), ("account_id", _L, "BIGINT"), ("limit_type", _S, "VARCHAR"),
        ("amount", MONEY, "DECIMAL(15,2)"), ("period", _S, "VARCHAR"),
        ("current_usage", MONEY, "DECIMAL(15,2)"), ("reset_at", _TS, "TIMESTAMP"),
        ("created_at", _TS, "TIMESTAMP"), ("updated_at", _TS, "TIMESTAMP"),
    ],
    "transfer_queue": [
        ("id", _L, "BIGINT"), ("from_account_id", _L, "BIGINT"), ("to_account_id", _L, "BIGINT"),
        ("amount", MONEY, "DECIMAL(15,2)"), ("description", _S, "VARCHAR"), ("status", _S, "VARCHAR"),
        ("scheduled_at", _TS, "TIMESTAMP"), ("processed_at", _TS, "TIMESTAMP"),
        ("transaction_id", _L, "BIGINT"), ("error_message", _S, "VARCHAR"),
        ("retry_count", _L, "BIGINT"), ("created_at", _TS, "TIMESTAMP"),
    ],
}

LEDGER_TABLES = tuple(TABLES)

# Posting requests (deposits, withdrawals, transfers in one frame).
REQUESTS = [
    ("request_id", _L, "BIGINT"), ("requested_at", _TS, "TIMESTAMP"),
    ("account_number", _S, "VARCHAR"), ("op", _S, "VARCHAR"), ("to_account", _S, "VARCHAR"),
    ("amount", MONEY, "DECIMAL(15,2)"), ("description", _S, "VARCHAR"),
]


def _spark_type(t) -> T.DataType:
    if t == _TS:
        # Parsing the name picks the session default (TIMESTAMP_NTZ under configure()).
        return T._parse_datatype_string("timestamp")
    return t


def struct(columns: list[tuple[str, object, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, _spark_type(t), True) for n, t, _ in columns])


def table_schema(table: str) -> T.StructType:
    return struct(TABLES[table])


def conform(df: DataFrame, columns: list[tuple[str, object, str]]) -> DataFrame:
    """Select the declared columns in order, casting present ones and filling
    absent ones with typed NULLs."""
    present = set(df.columns)
    cols: list[Column] = []
    for name, t, _ in columns:
        st = _spark_type(t)
        src = F.col(name) if name in present else F.lit(None)
        cols.append(src.cast(st).alias(name))
    return df.select(*cols)


def conform_sql(source_sql: str, columns: list[tuple[str, object, str]], present: list[str]) -> str:
    """DuckDB text that gives ``source_sql`` the same declared column list."""
    parts = []
    for name, _, duck in columns:
        src = name if name in present else "NULL"
        parts.append(f"CAST({src} AS {duck}) AS {name}")
    return f"SELECT {', '.join(parts)} FROM ({source_sql}) AS src"
