"""The live ledger between posting batches (S8): facts appended, state merged on read.

Layout under a root folder (shared on a cluster):

    <root>/facts/<table>/batch=<n>/     transactions, alerts, audit_logs: append only
    <root>/state/<table>/base=<n>/      accounts, account_limits, users, sessions, transfer_queue: every row as of
                                        batch <n>; readable once the write's _SUCCESS file is there
    <root>/state/<table>/delta=<n>/     the rows that batch <n> changed (``_gone``: removed)
    <root>/commits/batch=<n>/           one row, written last: batch <n> is complete
    <root>/keys/run=<lo>-<hi>/          filters of the fact keys (``constraints``)

A batch costs its new fact rows plus the state rows it changed; neither the history nor the state
is rewritten. Readers take the newest commit and read fact partitions
``batch <= n`` (partition pruning) and, per state table, the newest base ``<= n`` with the later deltas up to
``n``: for each key the row of the highest batch wins (:func:`read_store`). Files of an
unfinished batch are never read, and a retry overwrites them.

:func:`compact` writes the merged state of the newest commit as a new base, so reads stay short;
:func:`apply_updates` does so after ``COMPACT_EVERY`` deltas. Older bases and deltas stay for point-in-time reads until
:func:`unreachable` finds that no batch from a given one on needs them and :func:`sweep` deletes them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .ledger import Ledger, Marks, empty_table

FACTS = ("transactions", "alerts", "audit_logs")
STATE = ("users", "accounts", "sessions", "account_limits", "transfer_queue")
#: Deltas of a table that are merged on read before a batch writes a new base.
COMPACT_EVERY = 16
GONE = "_gone"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The ``<prefix>=<n>`` children of a folder (a short directory listing)."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(prefix + "="):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def _with_batch(schema: T.StructType) -> T.StructType:
    """The schema plus the ``batch`` partition column (a new object)."""
    return T.StructType(list(schema.fields) + [T.StructField("batch", T.LongType())])


def committed(spark: SparkSession, root: str) -> int | None:
    done = _numbers(spark, os.path.join(root, "commits"), "batch")
    return done[-1] if done else None


# A batch folder above the last commit is never read, so a retried batch may
# overwrite what a failed attempt left there.
def write_fact(df: DataFrame, root: str, table: str, batch: int) -> None:
    path = os.path.join(root, "facts", table, f"batch={batch}")
    schemas.conform(df, schemas.TABLES[table]).write.mode("overwrite").parquet(path)


def _state(root: str, table: str, kind: str, batch: int) -> str:
    return os.path.join(root, "state", table, f"{kind}={batch}")


def _write_base(df: DataFrame, root: str, table: str, batch: int) -> None:
    schemas.conform(df, schemas.TABLES[table]).write.mode("overwrite").parquet(_state(root, table, "base", batch))


def _write_delta(changed: DataFrame, root: str, table: str, batch: int) -> None:
    """``changed``: whole rows, and optionally ``_gone`` for removed ones (only their id counts)."""
    gone = F.coalesce(F.col(GONE), F.lit(False)) if GONE in changed.columns else F.lit(False)
    rows = schemas.conform(changed.withColumn(GONE, gone), [*schemas.TABLES[table], (GONE, T.BooleanType(), "BOOLEAN")])
    rows.write.mode("overwrite").parquet(_state(root, table, "delta", batch))


def _bases(spark: SparkSession, root: str, table: str) -> list[int]:
    """The finished bases of a table."""
    out = []
    for n in _numbers(spark, os.path.join(root, "state", table), "base"):
        fs, p = _fs(spark, os.path.join(_state(root, table, "base", n), "_SUCCESS"))
        if fs.exists(p):
            out.append(n)
    return out


def _parts(spark: SparkSession, root: str, table: str, batch: int) -> tuple[int | None, list[int]]:
    """The base and the deltas that a read at ``batch`` merges."""
    base = max((n for n in _bases(spark, root, table) if n <= batch), default=None)
    deltas = _numbers(spark, os.path.join(root, "state", table), "delta")
    return base, [n for n in deltas if n <= batch and (base is None or n > base)]


def read_state(spark: SparkSession, root: str, table: str, batch: int) -> DataFrame:
    """A state table as of a committed batch: the base without the keys of later deltas, and their latest rows."""
    base, deltas = _parts(spark, root, table, batch)
    schema = schemas.table_schema(table)
    if base is None:
        if _bases(spark, root, table) or deltas:
            raise RuntimeError(f"the state of {table} at batch {batch} was removed by retention")
        return empty_table(spark, table)
    rows = spark.read.schema(schema).parquet(_state(root, table, "base", base))
    if not deltas:
        return schemas.conform(rows, schemas.TABLES[table])
    kind = T.StructType([*schema, T.StructField(GONE, T.BooleanType()), T.StructField("delta", T.LongType())])
    paths = [_state(root, table, "delta", n) for n in deltas]
    changed = spark.read.schema(kind).option("basePath", os.path.join(root, "state", table)).parquet(*paths)
    latest = changed.groupBy("id").agg(F.max_by(F.struct(*[c for c in kind.names if c not in ("id", "delta")]), "delta").alias("r"))
    rows = rows.join(latest.select("id"), "id", "left_anti").unionByName(latest.where(f"NOT r.{GONE}").select("id", "r.*").drop(GONE))
    return schemas.conform(rows, schemas.TABLES[table])


def compact(spark: SparkSession, root: str, tables: tuple[str, ...] = STATE, least: int = 1) -> list[str]:
    """Write the newest committed state of tables with at least ``least`` deltas as new bases; their names."""
    n, done = committed(spark, root), []
    for t in tables:
        if len(_parts(spark, root, t, n)[1]) >= least:
            _write_base(read_state(spark, root, t, n), root, t, n)
            done.append(t)
    return done


def unreachable(spark: SparkSession, root: str, oldest: int) -> list[str]:
    """State folders that no read at a batch from ``oldest`` on needs: all before the base that ``oldest``
    reads. Facts and commits stay, and so do folders above the newest commit (a running batch)."""
    out = []
    for t in STATE:
        base, _ = _parts(spark, root, t, oldest)
        if base is not None:
            out += [_state(root, t, "base", n) for n in _numbers(spark, os.path.join(root, "state", t), "base") if n < base]
            out += [_state(root, t, "delta", n) for n in _numbers(spark, os.path.join(root, "state", t), "delta") if n <= base]
    return out


def sweep(spark: SparkSession, root: str, oldest: int) -> list[str]:
    """Delete what :func:`unreachable` names."""
    paths = unreachable(spark, root, oldest)
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return paths


def write_batch_rows(df: DataFrame, root: str, name: str, batch: int) -> None:
    """Other per-batch rows (e.g. posting results), visible once committed."""
    df.write.mode("overwrite").parquet(os.path.join(root, name, f"batch={batch}"))


def read_batch_rows(spark: SparkSession, root: str, name: str, schema, last: int | None = None) -> DataFrame | None:
    """The committed per-batch rows, or only those of the ``last`` batches (the
    partition filter prunes the others' folders)."""
    n = committed(spark, root)
    path = os.path.join(root, name)
    if n is None or not _numbers(spark, path, "batch"):
        return None
    rows = spark.read.schema(_with_batch(schema)).parquet(path).where(F.col("batch") <= n)
    return rows if last is None else rows.where(F.col("batch") > n - last)


def _commit(spark: SparkSession, root: str, batch: int, as_of: str, marks: Marks, epoch: int | None) -> None:
    """The marker row: the highest ids so far, and the stream's micro-batch that the batch
    holds (the last one, if this batch comes from elsewhere)."""
    spark.range(1).select(
        F.to_timestamp(F.lit(as_of)).alias("as_of"), F.lit(marks.transactions).cast("bigint").alias("max_transaction"),
        F.lit(marks.audit_logs).cast("bigint").alias("max_audit"), F.lit(epoch).cast("bigint").alias("epoch"),
    ).write.parquet(os.path.join(root, "commits", f"batch={batch}"))


def last_commit(spark: SparkSession, root: str) -> tuple[Marks, int | None]:
    """The newest marker's highest ids and micro-batch: one row, whatever the history's size."""
    n = committed(spark, root)
    row = spark.read.parquet(os.path.join(root, "commits", f"batch={n}")).first()
    return Marks(row.max_transaction, row.max_audit), row.epoch


def init_store(ledger: Ledger, root: str, as_of: str) -> None:
    """Batch 0: every table as it is now."""
    for t in FACTS:
        write_fact(getattr(ledger, t), root, t, 0)
    for t in STATE:
        _write_base(getattr(ledger, t), root, t, 0)
    _commit(ledger.users.sparkSession, root, 0, as_of, Marks.of(ledger), None)


def read_store(spark: SparkSession, root: str, batch: int | None = None) -> Ledger:
    """The ledger as of a committed batch (the newest by default)."""
    n = committed(spark, root) if batch is None else batch
    if n is None:
        raise RuntimeError(f"no committed batch under {root}")
    tables = {}
    for t in FACTS:
        path = os.path.join(root, "facts", t)
        if _numbers(spark, path, "batch"):
            df = spark.read.schema(_with_batch(schemas.table_schema(t))).parquet(path)
            tables[t] = schemas.conform(df.where(F.col("batch") <= n), schemas.TABLES[t])
        else:
            tables[t] = empty_table(spark, t)
    for t in STATE:
        tables[t] = read_state(spark, root, t, n)
    return Ledger(**tables)


def next_batch(spark: SparkSession, root: str) -> int:
    last = committed(spark, root)
    return 0 if last is None else last + 1


def apply_updates(root: str, outcome, as_of: str, batch: int | None = None,
                  extra: dict[str, DataFrame] | None = None, epoch: int | None = None, references: bool = False) -> int:
    """Append a posting outcome as the next batch and commit it.

    New transactions, alerts and audit rows are appended; of accounts and limits the rows that the
    transactions changed are written as the batch's delta; ``extra`` per-batch rows (name -> frame) are
    written too. A batch that repeats a unique key, its own or a stored one, is not committed
    (``constraints.ConstraintViolation``); ``references`` also refuses references to missing rows. The commit marker is
    written last, with the highest ids and the stream's ``epoch``; then tables
    with ``COMPACT_EVERY`` deltas are compacted. Returns the batch number."""
    from . import constraints

    spark = outcome.results.sparkSession
    n = next_batch(spark, root) if batch is None else batch
    for name, df in (extra or {}).items():
        write_batch_rows(df, root, name, n)
    write_fact(outcome.transactions, root, "transactions", n)
    write_fact(outcome.alerts, root, "alerts", n)
    write_fact(outcome.audit_logs, root, "audit_logs", n)
    # the new fact rows, read back, say which state rows differ
    posted = spark.read.schema(schemas.table_schema("transactions")).parquet(os.path.join(root, "facts", "transactions", f"batch={n}"))
    _write_delta(outcome.accounts.join(posted.select(F.col("account_id").alias("id")).distinct(), "id", "left_semi"), root, "accounts", n)
    debits = posted.where("type = 'withdrawal' AND related_account_id IS NULL").select("account_id").distinct()
    limits = outcome.account_limits.where("limit_type = 'daily_withdrawal'")
    _write_delta(limits.join(debits, "account_id", "left_semi"), root, "account_limits", n)
    constraints.refuse(constraints.violations(spark, root, n, references), n)
    before, last_epoch = last_commit(spark, root)
    audit = spark.read.schema(schemas.table_schema("audit_logs")).parquet(os.path.join(root, "facts", "audit_logs", f"batch={n}"))
    new = posted.agg(F.max("id")).first()[0], audit.agg(F.max("id")).first()[0]  # of the rows as written, not computed again
    marks = Marks(max(before.transactions, new[0] or 0), max(before.audit_logs, new[1] or 0))
    _commit(spark, root, n, as_of, marks, last_epoch if epoch is None else epoch)
    compact(spark, root, ("accounts", "account_limits"), COMPACT_EVERY)
    return n


def apply_changes(spark: SparkSession, root: str, changed: dict[str, DataFrame], as_of: str) -> int:
    """Commit changed rows of state tables (with ``_gone`` for removed ones) as a batch of their own, e.g. from the
    jobs that reset limits, expire sessions or purge accounts. Rows that repeat a unique column are refused
    (``constraints.ConstraintViolation``)."""
    from . import constraints

    n = next_batch(spark, root)
    constraints.refuse(constraints.state_violations(spark, root, changed), n)
    for table, rows in changed.items():
        _write_delta(rows, root, table, n)
    marks, epoch = last_commit(spark, root)
    _commit(spark, root, n, as_of, marks, epoch)
    compact(spark, root, tuple(changed), COMPACT_EVERY)
    return n
