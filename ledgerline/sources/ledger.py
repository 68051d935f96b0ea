"""The ledger as a set of typed DataFrames (S1 load, S3 seeds, S4 verify).

A ``Ledger`` is one version of the eight tables. Jobs never mutate it; they
return new frames, and :mod:`ledgerline.sources.snapshots` writes versions.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas


@dataclass(frozen=True)
class Ledger:
    users: DataFrame
    accounts: DataFrame
    transactions: DataFrame
    audit_logs: DataFrame
    sessions: DataFrame
    alerts: DataFrame
    account_limits: DataFrame
    transfer_queue: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **changes: DataFrame) -> "Ledger":
        return replace(self, **changes)


@dataclass(frozen=True)
class Marks:
    """The ledger's highest ids before a batch: its new rows continue from them."""

    transactions: int
    audit_logs: int

    @staticmethod
    def of(ledger: Ledger) -> Marks:
        def top(df: DataFrame) -> int:
            return df.agg(F.max("id")).first()[0] or 0

        return Marks(top(ledger.transactions), top(ledger.audit_logs))


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schemas.table_schema(table))


def load_ledger(spark: SparkSession, path: str) -> Ledger:
    """Typed read of ``<path>/<table>`` Parquet directories.

    The declared schema is applied at read time (no inference); a missing
    table reads as empty. Filters and projections applied later push down
    into the Parquet scan."""
    tables = {}
    for t in schemas.LEDGER_TABLES:
        p = os.path.join(path, t)
        if _exists(spark, p):
            tables[t] = schemas.conform(spark.read.schema(schemas.table_schema(t)).parquet(p), schemas.TABLES[t])
        else:
            tables[t] = empty_table(spark, t)
    return Ledger(**tables)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def verify_load(ledger: Ledger) -> DataFrame:
    """Row count per table, as one ``UNION ALL`` of per-table counts."""
    parts = [
        df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in ledger.tables().items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The known test accounts (email, account_number, type, balance).
SEED_ACCOUNTS = [
    ("John", "Doe", "john.doe@example.com", "KB2025010100001", "checking", "5000.00"),
    ("John", "Doe", "john.doe@example.com", "KB2025010100002", "savings", "15000.00"),
    ("Jane", "Smith", "jane.smith@example.com", "KB2025010200001", "checking", "3500.00"),
    ("Jane", "Smith", "jane.smith@example.com", "KB2025010200002", "savings", "25000.00"),
    ("Bob", "Johnson", "bob.johnson@example.com", "KB2025010300001", "business", "50000.00"),
]


def load_seeds(ledger: Ledger, created_at: str) -> Ledger:
    """S3: append the known test users and accounts to a ledger.

    New ids continue after the current maximum (A9): a user's id is
    ``max(users.id) + rank of its email``, an account's ``max(accounts.id) + its
    position in the seed list``. Accounts are active with default overdraft
    and rate."""
    spark = ledger.accounts.sparkSession
    seed = spark.createDataFrame(
        [(i + 1, *row) for i, row in enumerate(SEED_ACCOUNTS)],
        "pos long, first_name string, last_name string, email string, account_number string, "
        "account_type string, balance string",
    )
    max_user = ledger.users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_user_id"), F.lit(1).alias("_k"))
    max_acct = ledger.accounts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_account_id"), F.lit(1).alias("_k"))
    # Attach the two one-row maxima (equi-join on a constant key; five rows out).
    seed = seed.withColumn("_k", F.lit(1)).join(F.broadcast(max_user), "_k").join(F.broadcast(max_acct), "_k")
    user_rank = F.dense_rank().over(Window.orderBy("email"))  # five rows
    seed = seed.withColumn("user_id", F.col("max_user_id") + user_rank)
    ts = F.to_timestamp(F.lit(created_at))
    new_users = seed.select(
        F.col("user_id").alias("id"), "first_name", "last_name", "email",
        F.lit("USA").alias("country"), ts.alias("created_at"), ts.alias("updated_at"),
    ).dropDuplicates(["id"])
    new_accounts = seed.select(
        (F.col("max_account_id") + F.col("pos")).alias("id"), "user_id", "account_number", "account_type",
        F.col("balance").cast(schemas.MONEY).alias("balance"), F.lit("USD").alias("currency"),
        F.lit("active").alias("status"), F.lit(0).cast(schemas.MONEY).alias("overdraft_limit"),
        F.lit(0).cast(schemas.RATE).alias("interest_rate"), ts.alias("created_at"), ts.alias("updated_at"),
    )
    return ledger.with_tables(
        users=ledger.users.unionByName(schemas.conform(new_users, schemas.TABLES["users"])),
        accounts=ledger.accounts.unionByName(schemas.conform(new_accounts, schemas.TABLES["accounts"])),
    )
