"""The skew-safe running sum equals a plain per-key window, however the
chunks fall (a tiny bucket target forces many chunks per key)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.scan import running_sums


def test_chunked_running_sum_equals_window(spark):
    # one hot key with most rows, a few small keys, ties in time broken by id
    rows = [(1 if i % 5 else 2 + i % 3, i // 3, i, (i * 7) % 11 - 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    got = running_sums(df, ["k"], ["t", "id"], {"s": F.col("v")}, target_rows=25)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())
    excl = running_sums(df, ["k"], ["t", "id"], {"s": F.col("v")}, inclusive=False, target_rows=25)
    w2 = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want2 = df.select("*", F.coalesce(F.sum("v").over(w2), F.lit(0)).alias("s"))
    assert sorted(excl.collect()) == sorted(want2.collect())


def test_running_balance_with_many_chunks(spark):
    from ledger_helpers import SF_SMALL

    from ledgerline import fixtures
    from ledgerline.operators.windows import running_balance

    led = fixtures.build(spark, SF_SMALL).ledger
    a = {r.id: (r.balance_before, r.balance_after) for r in running_balance(led.transactions, target_rows=50).collect()}
    b = {r.id: (r.balance_before, r.balance_after) for r in running_balance(led.transactions).collect()}
    assert a == b and len(a) > 0


def test_null_times_keys_and_values_lose_no_row(spark):
    rows = [(None if i % 9 == 0 else i % 3, None if i % 4 == 0 else i // 5, i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = sorted(df.select("*", F.sum("v").over(w).alias("s")).collect(), key=str)
    for target in (20, 1_000_000):
        assert sorted(running_sums(df, ["k"], ["t", "id"], {"s": F.col("v")}, target_rows=target).collect(), key=str) == want


def test_chunks_stay_balanced(spark):
    from ledgerline.operators.scan import add_chunks

    cases = {
        "outlier": [(1, 10_000_000 + i, i) for i in range(5000)] + [(1, 0, 9999)],
        "equal times": [(1, 7, i) for i in range(5000)],
        "hot key": [(1 if i % 10 else i, i // 50, i) for i in range(5000)],
        "no times": [(1, None, i) for i in range(5000)],
    }
    for name, rows in cases.items():
        df = add_chunks(spark.createDataFrame(rows, "k long, t long, id long"), ["t", "id"], target_rows=500)
        assert df.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 1000, name
        assert df.count() == len(rows)
