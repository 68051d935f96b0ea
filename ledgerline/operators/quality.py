"""Table constraints as a violations report (Q1-Q6).

Every report has the columns ``table_name, rule, column_name, row_key, value,
n_rows``. A CHECK passes on NULL, so a row violates ``check`` when
``NOT coalesce(check, true)``. Row rules run as one scan per table: an array
of (column, failed, value) structs, exploded and filtered. UNIQUE is a
``groupBy ... having count > 1`` (map-side partial counts, one row per
duplicated value). Foreign keys take the distinct child keys (partial
aggregate), anti-join them with the parent keys, then semi-join the few
missing keys back to list the rows: a hot key is never shuffled row by row
unless it is itself missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schemas import LEDGER_TABLES
from ..sources.ledger import Ledger

# The constraints declared on the ledger tables.
NOT_NULL = {
    "users": ["first_name", "last_name", "email"],
    "accounts": ["user_id", "account_number", "balance"],
    "transactions": ["account_id", "type", "amount"],
    "audit_logs": ["action"],
    "sessions": ["user_id", "token_hash", "expires_at"],
    "alerts": ["type", "title", "message"],
    "account_limits": ["account_id", "limit_type", "amount"],
    "transfer_queue": ["from_account_id", "to_account_id", "amount"],
}
UNIQUE = [("users", "email"), ("accounts", "account_number"), ("transactions", "reference_number")] + [
    (t, "id") for t in LEDGER_TABLES
]
DOMAIN = [
    ("accounts", "account_type", X.ACCOUNT_TYPES),
    ("accounts", "status", X.ACCOUNT_STATUSES),
    ("transactions", "type", X.TRANSACTION_TYPES),
    ("transactions", "status", X.TRANSACTION_STATUSES),
    ("alerts", "severity", X.SEVERITIES),
    ("account_limits", "limit_type", X.LIMIT_TYPES),
    ("account_limits", "period", X.LIMIT_PERIODS),
    ("transfer_queue", "status", X.QUEUE_STATUSES),
]
FORMAT = [("users", "email"), ("accounts", "account_number")]
RANGE = [
    ("accounts", "balance", "balance >= -overdraft_limit"),
    ("transactions", "amount", "amount > 0"),
    ("account_limits", "amount", "amount > 0"),
]
FOREIGN_KEYS = [
    ("accounts", "user_id", "users"),
    ("transactions", "account_id", "accounts"),
    ("transactions", "related_account_id", "accounts"),
    ("transactions", "related_transaction_id", "transactions"),
    ("audit_logs", "user_id", "users"),
    ("audit_logs", "account_id", "accounts"),
    ("audit_logs", "transaction_id", "transactions"),
    ("sessions", "user_id", "users"),
    ("alerts", "user_id", "users"),
    ("alerts", "account_id", "accounts"),
    ("alerts", "transaction_id", "transactions"),
    ("account_limits", "account_id", "accounts"),
    ("transfer_queue", "from_account_id", "accounts"),
    ("transfer_queue", "to_account_id", "accounts"),
    ("transfer_queue", "transaction_id", "transactions"),
]

OUT = ["table_name", "rule", "column_name", "row_key", "value", "n_rows"]


Check = tuple[str, str, Column, Column]  # rule, column name, failed?, offending value


def _row_rules(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """All row rules of a table in one scan; only failed ones are exploded."""
    arr = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.coalesce(failed, F.lit(False)).alias("f"), value.cast("string").alias("v"))
                    for r, c, failed, value in checks])
    failed = df.select(F.col("id").cast("string").alias("row_key"), F.filter(arr, lambda x: x["f"]).alias("_a")).where(F.size("_a") > 0)
    return failed.select("row_key", F.explode("_a").alias("_r")).select(
        F.lit(table).alias("table_name"), F.col("_r.r").alias("rule"), F.col("_r.c").alias("column_name"),
        "row_key", F.col("_r.v").alias("value"), F.lit(1).cast("bigint").alias("n_rows"))


def _by_table(ledger: Ledger, *families: dict[str, list[Check]]) -> DataFrame:
    t, merged = ledger.tables(), {}
    for family in families:
        for table, checks in family.items():
            merged.setdefault(table, []).extend(checks)
    return _union([_row_rules(t[tb], tb, checks) for tb, checks in merged.items()], ledger.users.sparkSession)


def _union(parts: list[DataFrame], spark) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "table_name string, rule string, column_name string, row_key string, "
                                         "value string, n_rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _violates(check: Column) -> Column:
    return ~F.coalesce(check, F.lit(True))


def _not_null() -> dict[str, list[Check]]:
    return {tb: [("not_null", c, F.col(c).isNull(), F.lit(None)) for c in cols] for tb, cols in NOT_NULL.items()}


def _domain() -> dict[str, list[Check]]:
    out: dict[str, list[Check]] = {}
    for tb, c, allowed in DOMAIN:
        out.setdefault(tb, []).append(("domain", c, _violates(F.col(c).isin(*allowed)), F.col(c)))
    return out


def _format() -> dict[str, list[Check]]:
    return {
        "users": [("format", "email", _violates(X.valid_email("email")), F.col("email"))],
        "accounts": [("format", "account_number", _violates(X.valid_account_number("account_number")), F.col("account_number"))],
    }


def _range() -> dict[str, list[Check]]:
    out: dict[str, list[Check]] = {}
    for tb, c, check in RANGE:
        out.setdefault(tb, []).append(("range", c, _violates(F.expr(check)), F.col(c)))
    return out


def dq_not_null(ledger: Ledger) -> DataFrame:
    """Q1: NOT NULL columns holding NULL."""
    return _by_table(ledger, _not_null())


def dq_unique(ledger: Ledger) -> DataFrame:
    """Q2: values held by more than one row (NULLs never collide)."""
    t = ledger.tables()
    parts = []
    for tb, c in UNIQUE:
        dup = t[tb].where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
        parts.append(dup.select(F.lit(tb).alias("table_name"), F.lit("unique").alias("rule"), F.lit(c).alias("column_name"),
                                F.lit(None).cast("string").alias("row_key"), F.col(c).cast("string").alias("value"),
                                "n_rows"))
    return _union(parts, ledger.users.sparkSession)


def dq_domain(ledger: Ledger) -> DataFrame:
    """Q3: values outside their declared set."""
    return _by_table(ledger, _domain())


def dq_format(ledger: Ledger) -> DataFrame:
    """Q4: email (case-insensitive) and account-number patterns of the tables."""
    return _by_table(ledger, _format())


def dq_range(ledger: Ledger) -> DataFrame:
    """Q5: balance floor, positive amounts and limits."""
    return _by_table(ledger, _range())


def dq_foreign_key(ledger: Ledger) -> DataFrame:
    """Q6: references to missing parent rows (NULL references are allowed)."""
    t = ledger.tables()
    parts = []
    for tb, c, parent in FOREIGN_KEYS:
        child = t[tb]
        keys = child.where(F.col(c).isNotNull()).select(F.col(c).alias("_k")).distinct()
        missing = keys.join(t[parent].select(F.col("id").alias("_k")), "_k", "left_anti")
        rows = child.join(missing, child[c] == missing._k, "left_semi")
        parts.append(rows.select(F.lit(tb).alias("table_name"), F.lit("foreign_key").alias("rule"),
                                 F.lit(c).alias("column_name"), F.col("id").cast("string").alias("row_key"),
                                 F.col(c).cast("string").alias("value"), F.lit(1).cast("bigint").alias("n_rows")))
    return _union(parts, ledger.users.sparkSession)


def quality_report(ledger: Ledger) -> DataFrame:
    """All six rule families in one report; the row rules take one scan per table."""
    rows = _by_table(ledger, _not_null(), _domain(), _format(), _range())
    return _union([rows, dq_unique(ledger), dq_foreign_key(ledger)], ledger.users.sparkSession)
