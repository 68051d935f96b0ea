"""Unique keys and references before a commit: filters, exact hits, refused batches, runs."""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from ledger_helpers import make_ledger, make_requests
from pyspark.sql import functions as F

from ledgerline.operators import posting as P
from ledgerline.sources import constraints as C
from ledgerline.sources import store as S

AS_OF = "2024-01-15 00:00:00"


def _ledger(spark, n=4):
    return make_ledger(spark, [{"id": i, "account_number": f"KB{i:010d}", "balance": 100} for i in range(1, n + 1)])


def _facts(spark, rows):
    """(id, reference, account, related transaction)"""
    df = spark.createDataFrame(rows, "id long, reference_number string, account_id long, related_transaction_id long")
    return df.withColumns({"type": F.lit("deposit"), "amount": F.lit(Decimal("1.00"))})


def _commit(spark, root, n, rows):
    S.write_fact(_facts(spark, rows), root, "transactions", n)
    S.apply_changes(spark, root, {}, AS_OF)


def _found(df):
    return sorted((r.table_name, r.rule, r.column_name, r.row_key, r.value, r.n_rows) for r in df.collect()) if df is not None else []


def test_filters_hold_every_key_and_few_others(spark, tmp_path):
    root, n = str(tmp_path), 5000
    S.init_store(_ledger(spark), root, AS_OF)
    _commit(spark, root, 1, [(i, f"R{i}", 1, None) for i in range(n)])
    asked = spark.range(2 * n).select(F.lit("transactions.id").alias("key"), F.col("id").cast("string").alias("value"))
    asked = asked.unionByName(spark.range(n).select(F.lit("transactions.reference_number").alias("key"), F.concat(F.lit("R"), "id").alias("value")))
    found = C.candidates(spark, root, asked, 1).cache()
    ids = {int(r.value) for r in found.where("key = 'transactions.id'").collect()}
    assert set(range(n)) <= ids and len(ids) < n * 1.01
    assert found.where("key like '%number'").count() == n and {(r.lo, r.hi) for r in found.collect()} == {(1, 1)}
    rows = spark.read.parquet(C._run(root, 1, 1)).collect()
    assert {r.buckets for r in rows} == {4} and all(len(r.bits) == 4096 for r in rows)


def test_violations_of_a_batch(spark, tmp_path):
    root = str(tmp_path)
    S.init_store(_ledger(spark), root, AS_OF)
    _commit(spark, root, 1, [(1, "a", 1, None), (2, None, 2, 1)])
    _commit(spark, root, 2, [(3, "b", 3, 3)])
    S.write_fact(_facts(spark, [
        (1, "c", 1, None), (4, "b", 1, 2), (5, "d", 99, 4), (6, "d", 2, 77), (7, None, 2, None), (8, None, 2, 9), (9, None, None, 9), (9, "", 4, 9),
    ]), root, "transactions", 3)
    t = "transactions"
    unique = [(t, "unique", "id", None, "1", 2), (t, "unique", "id", None, "9", 2), (t, "unique", "reference_number", None, "b", 2),
              (t, "unique", "reference_number", None, "d", 2)]
    lost = [(t, "foreign_key", "account_id", "5", "99", 1), (t, "foreign_key", "related_transaction_id", "6", "77", 1)]
    assert _found(C.violations(spark, root, 3)) == sorted(lost + unique)
    assert _found(C.violations(spark, root, 3, references=False)) == sorted(unique)
    S.write_fact(_facts(spark, []), root, "transactions", 3)
    assert _found(C.violations(spark, root, 3)) == []


def test_no_candidate_no_read_of_the_facts(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    S.init_store(_ledger(spark), root, AS_OF)
    _commit(spark, root, 1, [(i, f"R{i}", 1, None) for i in range(100)])
    C.runs(spark, root, 1)
    read, whole = [], C._facts
    monkeypatch.setattr(C, "_facts", lambda s, r, t, lo, hi: read.append((t, lo, hi)) or whole(s, r, t, lo, hi))
    keys = spark.createDataFrame([("transactions.id", "100000"), ("transactions.reference_number", "new")], "key string, value string")
    assert C.stored(spark, root, keys, 1).count() == 0 and read == []
    keys = spark.createDataFrame([("transactions.id", "7"), ("transactions.reference_number", "new")], "key string, value string")
    assert [r.value for r in C.stored(spark, root, keys, 1).collect()] == ["7"] and read == [("transactions", 0, 1)]


def test_a_repeated_batch_is_refused_and_the_store_goes_on(spark, tmp_path):
    root = str(tmp_path)
    S.init_store(_ledger(spark), root, AS_OF)
    first = P.post(make_requests(spark, [(1, "2024-01-01 10:00:00", "KB0000000001", "deposit", None, 5)]), S.read_store(spark, root), AS_OF)
    assert S.apply_updates(root, first, AS_OF, references=True) == 1
    with pytest.raises(C.ConstraintViolation, match="transactions.id unique"):
        S.apply_updates(root, first, AS_OF)
    assert S.committed(spark, root) == 1 and S.read_store(spark, root).transactions.count() == 1
    marks, _ = S.last_commit(spark, root)
    other = P.post(make_requests(spark, [(2, "2024-01-02 10:00:00", "KB0000000001", "deposit", None, 6)]), S.read_store(spark, root), AS_OF, marks=marks)
    assert S.apply_updates(root, other, AS_OF) == 2
    assert {r.id: r.balance for r in S.read_store(spark, root).accounts.collect()}[1] == Decimal("111.00")


def test_state_rows_that_repeat_a_unique_column(spark, tmp_path):
    root = str(tmp_path)
    S.init_store(_ledger(spark), root, AS_OF)
    accounts = S.read_store(spark, root).accounts
    taken = accounts.where("id = 2").withColumn("account_number", F.lit("KB0000000003"))
    with pytest.raises(C.ConstraintViolation, match="accounts.account_number"):
        S.apply_changes(spark, root, {"accounts": taken}, AS_OF)
    gone = accounts.where("id = 3").withColumn("_gone", F.lit(True))
    S.apply_changes(spark, root, {"accounts": taken.withColumn("_gone", F.lit(False)).unionByName(gone)}, AS_OF)  # 3 makes room
    assert {r.id: r.account_number for r in S.read_store(spark, root).accounts.where("id = 2").collect()} == {2: "KB0000000003"}


def test_runs_grow_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(C, "SPAN", 2)
    S.init_store(_ledger(spark), root, AS_OF)
    for n in range(1, 6):
        _commit(spark, root, n, [(n, f"R{n}", 1, None)])
        C.runs(spark, root, n)
    assert C.runs(spark, root, 5) == [(0, 0), (1, 4), (5, 5)] and C.runs(spark, root, 3) == [(0, 0), (1, 2), (3, 3)]
    os.makedirs(C._run(root, 1, 5))  # a run that was not finished is not read
    keys = spark.range(8).select(F.lit("transactions.id").alias("key"), F.col("id").cast("string").alias("value"))
    assert {r.value for r in C.stored(spark, root, keys, 5).collect()} == {"1", "2", "3", "4", "5"}
