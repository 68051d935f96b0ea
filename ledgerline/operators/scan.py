"""Per-key running sums that stay balanced when one key is huge.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task; with one account holding a third of all rows that task is the job. The
scan here is the classic two-level prefix sum:

1. Every row gets a *chunk*: the table is range-partitioned by the whole order
   (NULLs first, ending with a unique id) into ``rows / target_rows`` parts, and
   the part's number is written with the rows, once, so every branch and retry
   reads the same chunks. Chunks hold about equally many rows whatever the
   times are: outliers, bursts and equal times only move their borders.
2. Inside a chunk: a window over ``(key, chunk)`` (bounded size).
3. Chunk totals: one row per (key, chunk) after a map-side aggregate; their
   exclusive prefix per key is a window over the chunks of one key.
4. Offsets join back on (key, chunk), null-safely; no row is lost.

The result is exact whatever the chunk borders are, since only the sums of
whole chunks cross them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import freeze

TARGET_ROWS = 2_000_000  # rows of a chunk, about


def add_chunks(df: DataFrame, order: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """The rows, written and read back, with ``_chunk``: the number of their part
    of the order (ascending, NULLs first)."""
    parts = max(1, -(-df.count() // target_rows))
    if parts == 1:
        return freeze(df.withColumn("_chunk", F.lit(0)), "ledgerline-chunks")
    dealt = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    return freeze(dealt.withColumn("_chunk", F.spark_partition_id()), "ledgerline-chunks")


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """The null-safe join condition on columns of both frames."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    inclusive: bool = True,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add, per output name, the sum of its value over earlier rows of the same key.

    ``inclusive`` counts the current row too. ``order`` sorts ascending, must
    make the order total (end with a unique id); NULLs come first."""
    base = add_chunks(df, order, target_rows)
    tmp = {name: f"_v_{name}" for name in values}
    base = base.select("*", *[c.alias(tmp[name]) for name, c in values.items()])

    upper = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    local = base.select(
        "*", *[F.coalesce(F.sum(tmp[n]).over(w), F.lit(0)).alias(f"_l_{n}") for n in values]
    )

    totals = base.groupBy(*keys, "_chunk").agg(*[F.sum(tmp[n]).alias(f"_t_{n}") for n in values])
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(wk), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    joined = local.join(offsets, same(local, offsets, [*keys, "_chunk"]), "inner")
    return joined.select(
        *[local[c] for c in df.columns],
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in values],
    )
