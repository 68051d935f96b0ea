"""Balances at any time without a replay (W4): a history of posted rows with periodic balance checkpoints.

Layout under a root folder (shared on a cluster):

    <root>/rows/batch=<n>/period=<p>/          account_id, id, created_at, balance_after of the posted rows
    <root>/checkpoints/batch=<n>/period=<p>/   each account's latest such row before the period's start
    <root>/commits/batch=<n>/                  the batch's periods, written last: batch <n> is complete

A period is ``months`` calendar months, numbered from year 0. Every period that holds rows has a checkpoint, but for
the first. A checkpoint is a maximum by ``(created_at, id)``, so it merges: a batch with late rows adds
its own candidates to the later checkpoints, and only for its own accounts, and a read takes the greatest. A new period gets the whole state.

:func:`balance_as_of` reads one checkpoint and one period's rows; :func:`balances_at` does so for many
(account, time) points. Rows without a time lie in no period and count for no balance, as in ``windows.balance_as_of``;
a latest row without ``balance_after`` gives NULL. An unfinished batch is never read and its retry overwrites it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..functions import expressions as X
from ..operators.scan import TARGET_ROWS, add_chunks, same
from ..session import discard, freeze
from . import store

#: Calendar months of a period: rows that a read merges against rows that the checkpoints hold.
MONTHS = 3
ROW = ["account_id", "created_at", "id", "balance_after"]


def _schema() -> T.StructType:
    fields = {f.name: f for f in schemas.table_schema("transactions")}
    return T.StructType([*[fields[c] for c in ROW], T.StructField("batch", T.LongType()), T.StructField("period", T.LongType())])


def period_of(time: Column, months: int) -> Column:
    return F.floor((F.year(time) * 12 + F.month(time) - 1) / months).cast("bigint")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The latest row by (created_at, id) for each of the keys."""
    order = F.struct("created_at", "id")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("created_at", "id", "balance_after"), order).alias("r"))
    return best.select(*keys, "r.*")


def _committed(spark: SparkSession, root: str) -> tuple[int | None, list[int], int | None]:
    """The newest batch, the periods that hold rows, and the months of a period (one small row a batch)."""
    n = store.committed(spark, root)
    if n is None:
        return None, [], None
    rows = spark.read.parquet(*[os.path.join(root, "commits", f"batch={i}") for i in store._numbers(spark, os.path.join(root, "commits"), "batch")])
    r = rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("periods")))).alias("p"), F.max("months").alias("m")).first()
    return n, r.p, r.m


def _read(spark: SparkSession, root: str, kind: str, batch: int, low: int, high: int) -> DataFrame:
    """The committed rows of a kind in the periods from ``low`` to ``high``; other periods' folders are pruned."""
    path = os.path.join(root, kind)
    if not store._numbers(spark, path, "batch"):
        return spark.createDataFrame([], _schema())
    return spark.read.schema(_schema()).parquet(path).where(F.col("batch").between(0, batch) & F.col("period").between(low, high))


def _spread(lasts: DataFrame, periods: list[int]) -> DataFrame:
    """Rows (one per account and period) as rows of those ``periods`` whose checkpoint they are: the ones after their own
    period up to the account's next. One row per account and checkpoint comes out."""
    following = F.lead("period").over(Window.partitionBy("account_id").orderBy("period"))
    listed = F.array(*[F.lit(p).cast("bigint") for p in periods]) if periods else F.array().cast("array<bigint>")
    held = F.filter(listed, lambda q: (q > F.col("period")) & (F.col("_next").isNull() | (q <= F.col("_next"))))
    return lasts.withColumn("_next", following).withColumn("period", F.explode(held)).drop("_next")


def append(posted: DataFrame, root: str, batch: int | None = None, months: int = MONTHS) -> int:
    """Add posted rows as the next batch and commit it; the batch's number. ``months`` counts for the first batch only."""
    spark = posted.sparkSession
    last, periods, known = _committed(spark, root)
    months = known or months
    n = batch if batch is not None else (0 if last is None else last + 1)
    if last is not None and n <= last:
        return n  # committed before
    rows = schemas.conform(posted, schemas.TABLES["transactions"]).select(*ROW).where("created_at IS NOT NULL")
    path = os.path.join(root, "rows", f"batch={n}")
    dated = rows.withColumn("period", period_of(F.col("created_at"), months))
    dated.repartition("period", F.pmod(F.hash("id"), F.lit(16))).write.mode("overwrite").partitionBy("period").parquet(path)
    own = sorted(store._numbers(spark, path, "period"))
    # checkpoints that are there get the batch's own candidates; new ones the whole state
    have, need = periods[1:], sorted({*periods, *own})[1:]
    added = [p for p in need if p not in have]
    if own and need:
        written = spark.read.schema(T.StructType([f for f in _schema() if f.name != "batch"])).parquet(path)
        lasts = freeze(latest(written, "account_id", "period").select(*ROW, "period"), "ledgerline-history")
        points = _spread(lasts, have)
        if added:
            points = points.unionByName(_spread(_lasts_before(spark, root, last, periods, added, months, lasts), added))
        points.repartition("period", F.pmod(F.hash("account_id"), F.lit(16))).write.mode("overwrite").partitionBy(
            "period").parquet(os.path.join(root, "checkpoints", f"batch={n}"))
        discard(lasts)
    array = F.array(*[F.lit(p).cast("bigint") for p in own]) if own else F.array().cast("array<bigint>")
    spark.range(1).select(array.alias("periods"), F.lit(months).alias("months")).write.mode("overwrite").parquet(
        os.path.join(root, "commits", f"batch={n}"))
    return n


def _lasts_before(spark: SparkSession, root: str, last: int | None, periods: list[int], added: list[int], months: int,
                  lasts: DataFrame) -> DataFrame:
    """The latest rows per account and period that make the ``added`` checkpoints: the batch's own and the earlier batches'.
    After the newest period its checkpoint and its rows suffice; a period between older ones reads the older rows."""
    if not periods:
        return lasts
    newest = periods[-1]
    if added[0] > newest:
        held = _read(spark, root, "checkpoints", last, newest, newest).withColumn("period", period_of(F.col("created_at"), months))
        earlier = held.unionByName(_read(spark, root, "rows", last, newest, newest))
    else:
        earlier = _read(spark, root, "rows", last, periods[0], newest)
    return latest(lasts.unionByName(earlier.select(*ROW, "period")), "account_id", "period").select(*ROW, "period")


def follow(spark: SparkSession, store_root: str, root: str, months: int = MONTHS) -> int:
    """Bring the history up to the ledger store's newest commit: its batches that the history lacks become one batch."""
    n, last = store.committed(spark, store_root), store.committed(spark, root)
    if last is None or last < n:
        facts = spark.read.schema(store._with_batch(schemas.table_schema("transactions"))).parquet(
            os.path.join(store_root, "facts", "transactions"))
        append(facts.where(F.col("batch").between((-1 if last is None else last) + 1, n)).where("status = 'completed'"), root, n, months)
    return n


def balance_as_of(spark: SparkSession, root: str, as_of: str) -> DataFrame:
    """W4 over the history: ``account_id, balance`` of every account with a row at or before ``as_of``. Reads the last
    checkpoint not after that time and the rows of its period."""
    n, periods, months = _committed(spark, root)
    empty = spark.createDataFrame([], _schema()).select("account_id", F.col("balance_after").alias("balance"))
    if not periods:
        return empty
    at = X.ts_literal(as_of)
    low = max((p for p in periods if p <= spark.range(1).select(period_of(at, months)).first()[0]), default=None)
    if low is None:
        return empty
    rows = _read(spark, root, "rows", n, low, low).where(F.col("created_at") <= at)
    return latest(rows.unionByName(_read(spark, root, "checkpoints", n, low, low)), "account_id").select(
        "account_id", F.col("balance_after").alias("balance"))


def balances_at(spark: SparkSession, root: str, points: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The as-of join: ``points`` (``account_id``, ``at``) with ``balance``, NULL where the account has no row by then.

    A point meets its account's checkpoint by an equal join and the rows of its one period in time order. That
    order is cut into equal chunks whatever the accounts are (``scan.add_chunks``); a chunk's last rows carry over to
    the later chunks, so a hot account's rows and points are never joined pairwise and never lie in one task. Repeated points
    come back as often as given; NULL points have no balance. Extra columns are not kept."""
    n, periods, months = _committed(spark, root)
    asked = points.select("account_id", F.col("at").cast(_schema()["created_at"].dataType).alias("at"))
    if not periods:
        return asked.withColumn("balance", F.lit(None).cast(schemas.MONEY))
    listed = F.array(*[F.lit(p).cast("bigint") for p in periods])
    low = F.array_max(F.filter(listed, lambda p: p <= period_of(F.col("at"), months)))
    asked = freeze(asked.withColumn("period", low), "ledgerline-points")
    used = [r[0] for r in asked.select("period").where("period IS NOT NULL").distinct().collect()]  # of the known periods
    rows = _read(spark, root, "rows", n, min(used, default=0), max(used, default=-1)).where(F.col("period").isin(used))
    held = _read(spark, root, "checkpoints", n, min(used, default=0), max(used, default=-1)).where(F.col("period").isin(used))
    row_type = T.StructType([_schema()[c] for c in ("created_at", "id", "balance_after")])
    candidate = F.struct("created_at", "id", "balance_after")
    events = rows.unionByName(held).select(
        "account_id", "period", F.lit(0).alias("_kind"), "created_at", "id", candidate.alias("_row")
    ).unionByName(asked.select("account_id", "period", F.lit(1).alias("_kind"), F.col("at").alias("created_at"),
                               F.lit(None).cast("bigint").alias("id"), F.lit(None).cast(row_type).alias("_row")))
    keys = ["account_id", "period"]
    base = add_chunks(events, ["period", "created_at", "_kind", "id"], target_rows)
    w = Window.partitionBy(*keys, "_chunk").orderBy("created_at", "_kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_own", F.last("_row", ignorenulls=True).over(w)).where("_kind = 1")
    ends = base.groupBy(*keys, "_chunk").agg(F.max("_row").alias("_end"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(wk).alias("_before"))
    joined = local.join(ends, same(local, ends, [*keys, "_chunk"]), "inner")
    found = F.when(local.account_id.isNotNull() & local.created_at.isNotNull(), F.coalesce(F.col("_own"), F.col("_before"))["balance_after"])
    return joined.select(local.account_id, local.created_at.alias("at"), found.alias("balance"))

