"""Unique keys and references of a store's new rows, checked before their commit (Q2 and Q6, incrementally).

A batch's new fact rows are written first and committed last; in between :func:`violations` holds them against
what the store has. The history's key columns are not read for that:

    <root>/keys/run=<lo>-<hi>/    blocked Bloom filters of the key columns of the fact batches lo..hi, as rows
                                  (key, buckets, bucket, bits): 32,768 bits a bucket, 16 bits a key

* A filter is a table: built, joined and stored by Spark, never gathered on the driver. A key has one bucket, so it costs
  one join row per filter size, and all its bits lie in one row of one run.
* Runs are built from committed batches when the next batch is checked. After every 16th batch the last 16 become one run,
  after every 256th the last 256, and so on: a check reads at most 15 runs a level, and a batch's keys are
  read again once a level.
* Only keys that a filter lets through (about 1 in 1,000 of the new ones) meet the stored column, and of that only
  the fact partitions of the runs that let them through, between the candidates' least and largest id. No candidate: no read.

State tables are small beside the facts: references to them, and their own unique columns
(:func:`state_violations`), are checked by joins. The reports have the columns of ``operators.quality``.
NULLs never collide, and NULL references are allowed.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.quality import FOREIGN_KEYS, OUT, UNIQUE
from ..session import discard, freeze
from . import store as S

KEYS = [(t, c) for t, c in UNIQUE if t in S.FACTS]
STATE_KEYS = [(t, c) for t, c in UNIQUE if t in S.STATE and c != "id"]
REFERENCES = [(t, c, parent) for t, c, parent in FOREIGN_KEYS if t in S.FACTS]
BUCKET_BITS, KEYS_A_BUCKET, PROBES = 32768, 2048, 6
#: Batches that become one run.
SPAN = 16
#: New keys up to this count are sent to the filters; beyond it both sides are shuffled.
BROADCAST_KEYS = 200_000
_FILTER = "key string, buckets bigint, bucket bigint, bits binary"


class ConstraintViolation(RuntimeError):
    """A batch breaks a unique key or a reference; it was not committed."""


def _name(table: str, column: str) -> str:
    return f"{table}.{column}"


def _facts(spark: SparkSession, root: str, table: str, lo: int, hi: int) -> DataFrame:
    """The fact rows of the batches lo..hi, committed or not."""
    path = os.path.join(root, "facts", table)
    if not S._numbers(spark, path, "batch"):
        return S.empty_table(spark, table).withColumn("batch", F.lit(0).cast("bigint"))
    return spark.read.schema(S._with_batch(schemas.table_schema(table))).parquet(path).where(F.col("batch").between(lo, hi))


def _keys(spark: SparkSession, root: str, lo: int, hi: int) -> DataFrame:
    """``key, value`` of all key columns of the batches."""
    parts = [
        _facts(spark, root, t, lo, hi).where(F.col(c).isNotNull()).select(F.lit(_name(t, c)).alias("key"), F.col(c).cast("string").alias("value"))
        for t, c in KEYS
    ]
    return reduce(DataFrame.unionByName, parts)


# --- filters -------------------------------------------------------------------


def _places(h: str) -> list:
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BUCKET_BITS)) for i in range(PROBES)]


def key_filter(keys: DataFrame) -> DataFrame:
    """The filters of ``key, value`` rows: for each key column as many buckets (a power of two) as its rows need."""
    # one row per key column
    buckets = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.count(F.lit(1)) / KEYS_A_BUCKET)))).cast("bigint")
    sizes = keys.groupBy("key").agg(buckets.alias("buckets"))
    placed = keys.join(F.broadcast(sizes), "key").select("key", "buckets", F.xxhash64("value").alias("h"))
    # by bucket before the bits are set: a task's partial bitmaps would outweigh its keys
    placed = placed.withColumn("bucket", F.pmod("h", "buckets")).repartition("key", "bucket")
    bits = placed.select("key", "buckets", "bucket", F.explode(F.array(*_places("h"))).alias("place"))
    return bits.groupBy("key", "buckets", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def _run(root: str, lo: int, hi: int) -> str:
    return os.path.join(root, "keys", f"run={lo}-{hi}")


def _built(spark: SparkSession, root: str) -> set[tuple[int, int]]:
    fs, p = S._fs(spark, os.path.join(root, "keys"))
    out = set()
    for st in fs.listStatus(p) if fs.exists(p) else []:
        lo, _, hi = st.getPath().getName().removeprefix("run=").partition("-")
        if fs.exists(S._fs(spark, os.path.join(_run(root, int(lo), int(hi)), "_SUCCESS"))[1]):
            out.add((int(lo), int(hi)))
    return out


def runs(spark: SparkSession, root: str, last: int) -> list[tuple[int, int]]:
    """The runs that cover the committed batches 0..last, the longest first from each place; missing ones are built."""
    built = _built(spark, root)

    def build(lo: int, hi: int) -> None:
        key_filter(_keys(spark, root, lo, hi)).write.mode("overwrite").parquet(_run(root, lo, hi))
        built.add((lo, hi))

    span = SPAN
    while last and last % span == 0:
        if (last - span + 1, last) not in built:
            build(last - span + 1, last)
        span *= SPAN
    out, at = [], 0
    while at <= last:
        if not any(lo == at and hi <= last for lo, hi in built):
            # up to the next run; batch 0 (the ledger at the start) has one of its own
            build(at, at if at == 0 else min([lo - 1 for lo, _ in built if lo > at] + [last]))
        out.append((at, max(hi for lo, hi in built if lo == at and hi <= last)))
        at = out[-1][1] + 1
    return out


def candidates(spark: SparkSession, root: str, keys: DataFrame, last: int) -> DataFrame:
    """``key, value, lo, hi``: the rows of ``keys`` (distinct ``key, value``) that the runs' filters let through."""
    parts = [
        spark.read.schema(_FILTER).parquet(_run(root, lo, hi)).withColumns({"lo": F.lit(lo).cast("bigint"), "hi": F.lit(hi).cast("bigint")})
        for lo, hi in runs(spark, root, last)
    ]
    filters = reduce(DataFrame.unionByName, parts)
    # key columns x powers of two
    sizes = filters.select("key", "buckets").distinct()
    probes = keys.join(F.broadcast(sizes), "key").withColumn("h", F.xxhash64("value")).withColumn("bucket", F.pmod("h", "buckets"))
    if keys.count() <= BROADCAST_KEYS:
        probes = F.broadcast(probes)
    found = filters.join(probes, ["key", "buckets", "bucket"])
    for place in _places("h"):
        byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found.where(F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found.select("key", "value", "lo", "hi")


def stored(spark: SparkSession, root: str, keys: DataFrame, last: int) -> DataFrame:
    """The rows of ``keys`` (distinct ``key, value``) that the committed batches 0..last hold."""
    found = freeze(candidates(spark, root, keys, last), "ledgerline-candidates")
    # key columns x runs
    spans = found.groupBy("key", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.expr("try_cast(value AS bigint)")).alias("least"),
        F.max(F.expr("try_cast(value AS bigint)")).alias("most")).collect()
    parts = [keys.limit(0).select("key", "value")]
    for t, c in KEYS:
        own = [r for r in spans if r.key == _name(t, c)]
        if not own:
            continue
        where = reduce(lambda a, b: a | b, [F.col("batch").between(r.lo, r.hi) for r in own])
        old = _facts(spark, root, t, 0, last).where(where)
        if c == "id":
            old = old.where(F.col(c).between(min(r.least for r in own), max(r.most for r in own)))
        wanted = found.where(F.col("key") == _name(t, c)).select("key", "value").distinct()
        if sum(r.n for r in own) <= BROADCAST_KEYS:
            wanted = F.broadcast(wanted)
        parts.append(old.select(F.col(c).cast("string").alias("value")).join(wanted, "value").select("key", "value").distinct())
    return reduce(DataFrame.unionByName, parts)


# --- reports -------------------------------------------------------------------


def _report(rows: DataFrame, table, rule: str, column, row_key, value, n_rows) -> DataFrame:
    return rows.select(table.alias("table_name"), F.lit(rule).alias("rule"), column.alias("column_name"),
                       row_key.cast("string").alias("row_key"), value.cast("string").alias("value"), n_rows.cast("bigint").alias("n_rows"))


def violations(spark: SparkSession, root: str, batch: int, references: bool = True) -> DataFrame:
    """The unique keys and (if wanted) references that the fact rows written for ``batch`` (not yet committed) break.
    ``n_rows`` of a unique key counts the batch's rows and the stored one."""
    new = freeze(_keys(spark, root, batch, batch).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")), "ledgerline-new-keys")
    wanted = new.select("key", "value", F.lit(True).alias("own"))
    if references:  # parents among the facts are in the batch or stored
        asked = [
            _facts(spark, root, t, batch, batch).where(F.col(c).isNotNull())
            .select(F.lit(_name(p, "id")).alias("key"), F.col(c).cast("string").alias("value")) for t, c, p in REFERENCES if p in S.FACTS
        ]
        asked = reduce(DataFrame.unionByName, asked).distinct().join(new, ["key", "value"], "left_anti")
        wanted = freeze(wanted.unionByName(asked.withColumn("own", F.lit(False))), "ledgerline-wanted")
    old = freeze(stored(spark, root, wanted.select("key", "value"), batch - 1), "ledgerline-stored")

    held = new.join(old.withColumn("old", F.lit(1)), ["key", "value"], "left")
    total = F.col("n") + F.coalesce("old", F.lit(0))
    name = F.split("key", "[.]")
    parts = [_report(held.where(total > 1), name[0], "unique", name[1], F.lit(None), F.col("value"), total)]
    missing = wanted.where(~F.col("own")).join(old, ["key", "value"], "left_anti")
    for t, c, parent in REFERENCES if references else ():
        rows = _facts(spark, root, t, batch, batch).where(F.col(c).isNotNull())
        if parent in S.FACTS:
            lost = missing.where(F.col("key") == _name(parent, "id")).select(F.col("value").cast("bigint").alias("_k"))
        else:
            lost = rows.select(F.col(c).alias("_k")).distinct()
            lost = lost.join(S.read_state(spark, root, parent, batch).select(F.col("id").alias("_k")), "_k", "left_anti")
        rows = rows.join(lost, F.col(c) == F.col("_k"), "left_semi")
        parts.append(_report(rows, F.lit(t), "foreign_key", F.lit(c), F.col("id"), F.col(c), F.lit(1)))
    return reduce(DataFrame.unionByName, parts).select(*OUT)


def state_violations(spark: SparkSession, root: str, changed: dict[str, DataFrame]) -> DataFrame | None:
    """Unique columns of state tables that ``changed`` rows (not the removed ones) break, among themselves or with the rows
    that stay as they are."""
    last, parts = S.committed(spark, root), []
    for t, c in STATE_KEYS:
        if t not in changed:
            continue
        rows = changed[t]
        live = rows.where(~F.coalesce(F.col(S.GONE), F.lit(False))) if S.GONE in rows.columns else rows
        new = live.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        kept = S.read_state(spark, root, t, last).select("id", c).join(rows.select("id"), "id", "left_anti")
        held = new.join(kept.select(c).distinct().withColumn("old", F.lit(1)), c, "left")
        total = F.col("n") + F.coalesce("old", F.lit(0))
        parts.append(_report(held.where(total > 1), F.lit(t), "unique", F.lit(c), F.lit(None), F.col(c), total))
    return reduce(DataFrame.unionByName, parts).select(*OUT) if parts else None


def refuse(report: DataFrame | None, batch: int) -> None:
    """Raise if the report has rows; the message shows the first few."""
    if report is None:
        return
    kept = freeze(report, "ledgerline-violations")
    first = kept.orderBy("table_name", "column_name", "value").limit(5).collect()
    if first:
        shown = "; ".join(f"{r.table_name}.{r.column_name} {r.rule} {r.value}" for r in first)
        raise ConstraintViolation(f"batch {batch} breaks {kept.count()} constraints, first: {shown}")
    discard(kept)
