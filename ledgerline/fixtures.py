"""Ledger-shaped inputs built from the driver's test tables.

The test directories hold TPC-H-like tables, not ledger tables. The view texts
below (fixed values, given with the test data) map them onto the ledger
shapes; they run unchanged on Spark and on DuckDB, so the same text feeds the
Spark jobs here and the WITH clauses of the SQL oracles. They only produce
input rows in the ledger schemas; none of a job's work happens here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .session import configure
from .sources.ledger import Ledger, empty_table

# ---------------------------------------------------------------------------
# The fixture view texts, verbatim, in the order they are built.
# ---------------------------------------------------------------------------
VIEW_SQL: dict[str, str] = {
    "users": """
SELECT c_custkey AS id, split_part(c_name,'#',1) AS first_name, split_part(c_name,'#',2) AS last_name,
  CASE WHEN c_custkey % 97 = 5 THEN concat('user', CAST(c_custkey AS STRING), '.example.com')
       WHEN c_custkey % 89 = 3 THEN 'shared@example.com'
       ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CAST(c_nationkey AS STRING) AS country,
  TIMESTAMP '1994-12-31 00:00:00' AS created_at,
  CASE WHEN c_custkey % 50 = 7 THEN TIMESTAMP '2000-01-01 00:00:00' END AS deleted_at
FROM customer""",
    "accounts": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 61 = 9 THEN c_custkey + 10000000 ELSE c_custkey END AS user_id,
  concat('KB', lpad(CAST(c_custkey AS STRING), 10, '0')) AS account_number,
  CASE c_custkey % 3 WHEN 0 THEN 'savings' WHEN 1 THEN 'checking' ELSE 'business' END AS account_type,
  CAST(CASE WHEN c_custkey % 25 = 9 THEN 0 ELSE c_acctbal END AS DECIMAL(15,2)) AS balance, 'USD' AS currency,
  CASE c_custkey % 20 WHEN 0 THEN 'frozen' WHEN 1 THEN 'closed' WHEN 2 THEN 'pending' ELSE 'active' END AS status,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 1000 ELSE 0 END AS DECIMAL(15,2)) AS overdraft_limit,
  CAST(CASE c_custkey % 3 WHEN 0 THEN 0.0425 WHEN 1 THEN 0.0010 ELSE 0.0000 END AS DECIMAL(5,4)) AS interest_rate,
  TIMESTAMP '1994-12-31 00:00:00' AS created_at
FROM customer""",
    "transactions": """
SELECT o_orderkey AS id, o_custkey AS account_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'withdrawal' WHEN '2-HIGH' THEN 'deposit' WHEN '3-MEDIUM' THEN 'transfer'
       WHEN '4-NOT SPECIFIED' THEN 'fee' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'interest' ELSE 'refund' END END AS type,
  CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  concat('order ', CAST(o_orderkey AS STRING)) AS description,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' SECOND * (o_orderkey % 86400) AS created_at
FROM orders""",
    "post_requests": """
SELECT event_id AS request_id, ts AS requested_at,
  concat('KB', lpad(CAST(user_id AS STRING), 10, '0')) AS account_number,
  CASE event_type WHEN 'signup' THEN 'deposit' WHEN 'purchase' THEN 'withdrawal' WHEN 'click' THEN 'transfer' ELSE 'deposit' END AS op,
  CASE WHEN event_type = 'click' AND event_id % 211 = 0 THEN 'KB9999999999'
       WHEN event_type = 'click' THEN concat('KB', lpad(CAST((user_id * 7) % 150 AS STRING), 10, '0')) END AS to_account,
  CAST(CASE event_type WHEN 'error' THEN -value WHEN 'signup' THEN value * 50 ELSE value * 10 END AS DECIMAL(15,2)) AS amount,
  event_type AS description
FROM events""",
    "sessions": """
SELECT event_id AS id, user_id, ts AS created_at, ts AS last_activity,
  ts + INTERVAL '24' HOUR AS expires_at, event_id % 5 <> 0 AS is_active
FROM events WHERE event_type = 'signup'""",
    "request_log": """
SELECT ts, CASE WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE event_type WHEN 'purchase' THEN '/api/transactions' WHEN 'signup' THEN '/api/accounts'
       ELSE '/api/accounts/:accountNumber' END AS route,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  CAST(value / 100 AS DECIMAL(10,4)) AS duration_s, concat('10.0.0.', CAST(user_id AS STRING)) AS ip
FROM events""",
    "account_limits": """
SELECT a.id * 3 + l.k AS id, a.id AS account_id, l.limit_type, CAST(l.amount AS DECIMAL(15,2)) AS amount, l.period,
  CAST(0 AS DECIMAL(15,2)) AS current_usage,
  CASE a.id % 3 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2023-12-31 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS reset_at
FROM accounts a CROSS JOIN (VALUES (0,'daily_withdrawal',1000,'daily'),(1,'daily_transfer',5000,'daily'),
  (2,'single_transaction',2000,'transaction')) AS l(k,limit_type,amount,period)""",
    "create_requests": """
SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 10 = 3 THEN -1 ELSE s_suppkey END AS user_id,
  'checking' AS account_type, CAST(s_acctbal AS DECIMAL(15,2)) AS initial_balance
FROM supplier""",
    "raw_requests": """
SELECT event_id AS request_id, CASE WHEN event_id % 101 = 0 THEN '{"invalid json}' ELSE
  concat('{"accountNumber":"', CASE WHEN event_id % 103 = 1 THEN 'INVALID123' ELSE concat('KB', lpad(CAST(user_id AS STRING), 10, '0')) END,
  '","type":"', CASE event_type WHEN 'signup' THEN 'deposit' WHEN 'view' THEN 'invalid_type' ELSE 'withdrawal' END,
  '","amount":', CAST(CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(15,2)) AS STRING), '}') END AS body
FROM events""",
}

# The fixed evaluation instant for the fixture (see the fixture notes: as_of 2024-01-15).
AS_OF = "2024-01-15 00:00:00"

RAW_TABLES = ("customer", "orders", "events", "supplier")
# Columns each fixture view produces (used to conform the oracle side).
VIEW_COLUMNS = {
    "users": ["id", "first_name", "last_name", "email", "country", "created_at", "deleted_at"],
    "accounts": ["id", "user_id", "account_number", "account_type", "balance", "currency", "status",
                 "overdraft_limit", "interest_rate", "created_at"],
    "transactions": ["id", "account_id", "type", "amount", "status", "description", "created_at"],
    "sessions": ["id", "user_id", "created_at", "last_activity", "expires_at", "is_active"],
    "account_limits": ["id", "account_id", "limit_type", "amount", "period", "current_usage", "reset_at"],
}


@dataclass
class Fixture:
    ledger: Ledger
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def build(spark: SparkSession, sf_dir: str) -> Fixture:
    """Ledger tables (conformed to the full schemas) plus the request frames."""
    configure(spark)
    for name in RAW_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    raw = {}
    for name in ("users", "accounts", "transactions", "post_requests", "sessions",
                 "request_log", "create_requests", "raw_requests"):
        raw[name] = spark.sql(VIEW_SQL[name])
    raw["accounts"].createOrReplaceTempView("accounts")
    raw["account_limits"] = spark.sql(VIEW_SQL["account_limits"])

    tables = {t: schemas.conform(raw[t], schemas.TABLES[t]) for t in VIEW_COLUMNS}
    tables["transfer_queue"] = _transfer_queue(raw["post_requests"], tables["accounts"])
    for t in ("audit_logs", "alerts"):
        tables[t] = empty_table(spark, t)
    ledger = Ledger(**tables)
    frames = {
        "post_requests": schemas.conform(raw["post_requests"], schemas.REQUESTS),
        "request_log": raw["request_log"],
        "create_requests": raw["create_requests"],
        "raw_requests": raw["raw_requests"],
    }
    return Fixture(ledger=ledger, frames=frames)


def _transfer_queue(post_requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfer requests as queue rows (pending, scheduled at request time).

    Numbers that match no account keep a NULL id (the queue's NOT NULL rule
    then reports them)."""
    from pyspark.sql import functions as F

    a_from = accounts.select(F.col("account_number").alias("_fn"), F.col("id").alias("from_account_id"))
    a_to = accounts.select(F.col("account_number").alias("_tn"), F.col("id").alias("to_account_id"))
    q = (
        post_requests.where(F.col("op") == "transfer")
        .join(a_from, F.col("account_number") == F.col("_fn"), "left")
        .join(a_to, F.col("to_account") == F.col("_tn"), "left")
        .select(
            F.col("request_id").alias("id"), "from_account_id", "to_account_id",
            F.col("amount").cast(schemas.MONEY).alias("amount"), "description",
            F.lit("pending").alias("status"), F.col("requested_at").alias("scheduled_at"),
            F.lit(0).cast("bigint").alias("retry_count"), F.col("requested_at").alias("created_at"),
        )
    )
    return schemas.conform(q, schemas.TABLES["transfer_queue"])


# ---------------------------------------------------------------------------
# Oracle side: the same views as DuckDB WITH clauses.
# ---------------------------------------------------------------------------
def oracle_with(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause defining the named fixture views for DuckDB.

    Ledger tables are conformed to their full declared schema, so a query can
    use any ledger column (absent ones are NULL), like the Spark side."""
    need = list(names)
    if "account_limits" in need and "accounts" not in need:
        need.insert(0, "accounts")
    if "transfer_queue" in need:
        for dep in ("post_requests", "accounts"):
            if dep not in need:
                need.insert(0, dep)
    ctes = []
    order = ["accounts", "users", "transactions", "sessions", "post_requests", "request_log",
             "create_requests", "raw_requests", "account_limits", "transfer_queue", "audit_logs", "alerts"]
    for name in sorted(need, key=order.index):
        if name == "account_limits":
            # The view reads the un-conformed accounts rows; they are the same values.
            body = VIEW_SQL[name].replace("FROM accounts a", "FROM _accounts_src a")
            ctes.append(f"_accounts_src AS ({VIEW_SQL['accounts']})")
            ctes.append(f"account_limits AS ({schemas.conform_sql(body, schemas.TABLES[name], VIEW_COLUMNS[name])})")
        elif name == "transfer_queue":
            body = """
SELECT r.request_id AS id, fa.id AS from_account_id, ta.id AS to_account_id, r.amount, r.description,
  'pending' AS status, r.requested_at AS scheduled_at, 0 AS retry_count, r.requested_at AS created_at
FROM post_requests r LEFT JOIN accounts fa ON r.account_number = fa.account_number
LEFT JOIN accounts ta ON r.to_account = ta.account_number WHERE r.op = 'transfer'"""
            present = ["id", "from_account_id", "to_account_id", "amount", "description", "status",
                       "scheduled_at", "retry_count", "created_at"]
            ctes.append(f"transfer_queue AS ({schemas.conform_sql(body, schemas.TABLES[name], present)})")
        elif name in ("audit_logs", "alerts"):
            ctes.append(f"{name} AS ({schemas.conform_sql('SELECT 1 AS _none WHERE false', schemas.TABLES[name], [])})")
        elif name in VIEW_COLUMNS:
            ctes.append(f"{name} AS ({schemas.conform_sql(VIEW_SQL[name], schemas.TABLES[name], VIEW_COLUMNS[name])})")
        elif name == "post_requests":
            present = [c for c, _, _ in schemas.REQUESTS]
            ctes.append(f"post_requests AS ({schemas.conform_sql(VIEW_SQL[name], schemas.REQUESTS, present)})")
        else:
            ctes.append(f"{name} AS ({VIEW_SQL[name]})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
