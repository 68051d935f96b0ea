"""Snapshots of the ledger (S5-S7): full, verified, consistent copies.

Layout under a root folder (a shared path on a cluster):

    <root>/snapshot-<yyyyMMddTHHmmss>/<table>/     one Parquet folder per table
    <root>/snapshot-<...>/manifest/                one row per table

``transactions`` is written partitioned by ``created_month`` and sorted by
``account_id`` inside files, so month filters prune folders and account
filters prune row groups by min/max statistics. The manifest is written
last: a snapshot without one is incomplete and is never read. A checksum is
``sum(xxhash64(row))`` as an exact decimal, computed by reading back what was
written (so it checks the files, not the lineage). Nothing is ever overwritten:
a new state is a new folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as X
from .ledger import Ledger, _exists, load_ledger

MANIFEST = "manifest"
ROWS_PER_FILE = 4_000_000  # transactions of a snapshot file, about: some 100 MB of Parquet


def snapshot_name(as_of: str) -> str:
    return "snapshot-" + as_of.replace("-", "").replace(":", "").replace(" ", "T")[:15]


def _checksum(df: DataFrame) -> DataFrame:
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Write one table. ``transactions`` is range-partitioned on (month,
    account) before the write, so a busy month is spread over several tasks
    and each file holds a sorted account range (row-group pruning)."""
    if table == "transactions":
        n = max(1, -(-df.count() // ROWS_PER_FILE))
        (df.withColumn("created_month", F.date_format("created_at", "yyyy-MM"))
         .repartitionByRange(n, "created_month", "account_id")
         .sortWithinPartitions("created_month", "account_id", "created_at")
         .write.mode("errorifexists").partitionBy("created_month").parquet(path))
    else:
        df.write.mode("errorifexists").parquet(path)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    df = spark.read.schema(schemas.table_schema(table)).parquet(path)
    return schemas.conform(df, schemas.TABLES[table])


def snapshot_export(ledger: Ledger, root: str, as_of: str, source: str = "ledgerline") -> DataFrame:
    """Write every table and then the manifest; returns the manifest rows
    (snapshot, table_name, row_count, checksum, created_at, source, path)."""
    spark = ledger.users.sparkSession
    name = snapshot_name(as_of)
    base = os.path.join(root, name)
    parts = []
    for table, df in ledger.tables().items():
        path = os.path.join(base, table)
        write_table(schemas.conform(df, schemas.TABLES[table]), path, table)
        parts.append(_checksum(read_table(spark, path, table)).select(
            F.lit(name).alias("snapshot"), F.lit(table).alias("table_name"), "row_count", "checksum",
            X.ts_literal(as_of).alias("created_at"), F.lit(source).alias("source"), F.lit(path).alias("path")))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    manifest.coalesce(1).write.mode("errorifexists").parquet(os.path.join(base, MANIFEST))
    return spark.read.parquet(os.path.join(base, MANIFEST))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of every complete snapshot under ``root``."""
    return spark.read.parquet(os.path.join(root, "snapshot-*", MANIFEST))


def snapshot_restore(spark: SparkSession, root: str, name: str) -> tuple[Ledger, DataFrame]:
    """Read a snapshot and verify it against its manifest.

    Refuses (raises) a snapshot with no manifest, no tables, a listed table
    without its folder, or counts or checksums that differ from the manifest's.
    Returns the ledger and the check rows (table_name, expected_rows,
    actual_rows, checksum_ok, ok)."""
    base = os.path.join(root, name)
    if not _exists(spark, os.path.join(base, MANIFEST)):
        raise RuntimeError(f"snapshot {name} has no manifest")
    manifest = spark.read.parquet(os.path.join(base, MANIFEST))
    listed = [r.table_name for r in manifest.select("table_name").collect()]  # one row per table
    if not listed:
        raise RuntimeError(f"snapshot {name} lists no tables")
    missing = [t for t in listed if not _exists(spark, os.path.join(base, t))]
    if missing:
        raise RuntimeError(f"snapshot {name} lacks {', '.join(sorted(missing))}")
    ledger = load_ledger(spark, base)
    parts = [_checksum(df).select(F.lit(t).alias("table_name"), F.col("row_count").alias("actual_rows"),
                                  F.col("checksum").alias("_actual_sum"))
             for t, df in ledger.tables().items()]
    actual = parts[0]
    for p in parts[1:]:
        actual = actual.unionByName(p)
    check = manifest.select("table_name", F.col("row_count").alias("expected_rows"), "checksum").join(
        actual, "table_name", "full_outer")
    out = check.select(
        "table_name", "expected_rows", "actual_rows",
        F.coalesce(F.col("checksum") == F.col("_actual_sum"), F.lit(False)).alias("checksum_ok"),
        F.coalesce((F.col("expected_rows") == F.col("actual_rows")) & (F.col("checksum") == F.col("_actual_sum")),
                   F.lit(False)).alias("ok"),
    )
    rows = out.collect()  # one row per table
    bad = sorted(r.table_name for r in rows if not r.ok)
    if bad:
        raise RuntimeError(f"snapshot {name} does not match its manifest: {', '.join(bad)}")
    return ledger, spark.createDataFrame(rows, out.schema)


def snapshot_retention(spark: SparkSession, root: str, as_of: str, keep_days: int = 30) -> DataFrame:
    """Manifest rows of snapshots older than ``keep_days`` before as_of.
    Deleting them is a separate, explicit step of the caller."""
    cutoff = X.ts_literal(as_of) - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    return list_snapshots(spark, root).where(F.col("created_at") < cutoff).select(
        "snapshot", "created_at", "table_name", "row_count")


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Name of the newest complete snapshot (the version pointer)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "snapshot-*", MANIFEST))
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return None
    row = list_snapshots(spark, root).agg(F.max_by("snapshot", F.struct("created_at", "snapshot")).alias("s")).collect()[0]
    return row.s
