"""Streams equal their batch form; snapshots round-trip and verify."""

from __future__ import annotations

import os
import tempfile

from ledger_helpers import SF_SMALL
from pyspark.sql import functions as F

from ledgerline import fixtures
from ledgerline.operators import posting as T
from ledgerline.sources import snapshots as S
from ledgerline.sources import store as ST
from ledgerline.streaming import posting as XP
from ledgerline.streaming import rates as XR

AS_OF = fixtures.AS_OF


def test_stream_posting_in_two_batches_equals_one_batch(spark):
    f = fixtures.build(spark, SF_SMALL)
    req = f["post_requests"]
    root = tempfile.mkdtemp(prefix="ll-stream-")
    src = os.path.join(root, "requests")
    cut = F.to_timestamp(F.lit("2024-01-15 00:00:00"))  # the fixture's requests span January 2024
    # two files in time order: the second written after the first
    req.where(F.col("requested_at") < cut).coalesce(1).write.parquet(os.path.join(src, "a"))
    req.where(F.col("requested_at") >= cut).coalesce(1).write.mode("append").parquet(os.path.join(src, "b"))
    store_root = os.path.join(root, "store")
    ST.init_store(f.ledger, store_root, AS_OF)
    q = XP.stream_posting(spark, os.path.join(src, "*"), store_root, os.path.join(root, "ckpt"),
                          AS_OF, max_files_per_trigger=1)
    q.awaitTermination()
    streamed = {r.request_id: (r.accepted, r.reason, r.new_balance) for r in
                XP.posted_results(spark, store_root).collect()}
    batch = {r.request_id: (r.accepted, r.reason, r.new_balance) for r in T.post(req, f.ledger, AS_OF).results.collect()}
    assert streamed == batch
    assert ST.committed(spark, store_root) == 2  # two micro-batches after batch 0
    final = ST.read_store(spark, store_root)
    assert final.transactions.count() == f.ledger.transactions.count() + \
        sum(1 for r in T.post(req, f.ledger, AS_OF).transactions.collect())


def test_rate_breaches_stream_equals_batch(spark):
    f = fixtures.build(spark, SF_SMALL)
    log = f["request_log"]
    root = tempfile.mkdtemp(prefix="ll-rate-")
    log.write.parquet(os.path.join(root, "log"))
    stream = spark.readStream.schema(log.schema).parquet(os.path.join(root, "log"))
    q = (XR.request_rate_breaches(stream, max_requests=1).writeStream.format("memory").queryName("rate_breaches")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    streamed = sorted(spark.table("rate_breaches").collect())
    batch = sorted(XR.request_rate_breaches(log, max_requests=1).collect())
    assert streamed == batch and len(batch) > 0


def test_snapshot_roundtrip_and_retention(spark):
    f = fixtures.build(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="ll-snap-")
    S.snapshot_export(f.ledger, root, "2023-11-01 00:00:00")
    S.snapshot_export(f.ledger, root, AS_OF)
    ledger, check = S.snapshot_restore(spark, root, S.snapshot_name(AS_OF))
    assert all(r.ok for r in check.collect())
    assert ledger.transactions.count() == f.ledger.transactions.count()
    old = {r.snapshot for r in S.snapshot_retention(spark, root, AS_OF).collect()}
    assert old == {S.snapshot_name("2023-11-01 00:00:00")}
    assert S.latest_snapshot(spark, root) == S.snapshot_name(AS_OF)


def test_stream_commits_name_epochs_and_marks(spark):
    """Three micro-batches, a forced replay and a resent request."""
    f = fixtures.build(spark, SF_SMALL)
    req = f["post_requests"].where("request_id < 300")
    root = tempfile.mkdtemp(prefix="ll-stream-")
    for i, name in enumerate("abc"):
        req.where(f"request_id % 3 = {i}").coalesce(1).write.parquet(os.path.join(root, "requests", name))
    store_root, src = os.path.join(root, "store"), os.path.join(root, "requests", "*")
    ST.init_store(f.ledger, store_root, AS_OF)
    XP.stream_posting(spark, src, store_root, os.path.join(root, "ckpt"), AS_OF, max_files_per_trigger=1).awaitTermination()
    marks, epoch = ST.last_commit(spark, store_root)
    assert ST.committed(spark, store_root) == 3 and epoch == 2
    ledger = ST.read_store(spark, store_root)
    assert marks.transactions == ledger.transactions.agg(F.max("id")).first()[0]
    assert marks.audit_logs == ledger.audit_logs.agg(F.max("id")).first()[0]
    assert ledger.transactions.count() == ledger.transactions.select("id").distinct().count()
    before = ledger.transactions.count()
    # a new checkpoint repeats the same micro-batches: all three epochs are known
    XP.stream_posting(spark, src, store_root, os.path.join(root, "ckpt2"), AS_OF, max_files_per_trigger=1).awaitTermination()
    # a further file resends an old request
    req.where("request_id = 3").coalesce(1).write.parquet(os.path.join(root, "requests", "d"))
    XP.stream_posting(spark, src, store_root, os.path.join(root, "ckpt"), AS_OF, max_files_per_trigger=1).awaitTermination()
    assert ST.committed(spark, store_root) == 3
    assert ST.read_store(spark, store_root).transactions.count() == before


def test_restore_refuses_a_damaged_snapshot(spark):
    import shutil

    import pytest

    f = fixtures.build(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="ll-snap-")
    S.snapshot_export(f.ledger, root, AS_OF)
    name = S.snapshot_name(AS_OF)
    with pytest.raises(RuntimeError, match="manifest"):
        S.snapshot_restore(spark, root, "snapshot-none")
    users = os.path.join(root, name, "users")
    f.ledger.users.limit(3).write.mode("overwrite").parquet(users)
    with pytest.raises(RuntimeError, match="users"):
        S.snapshot_restore(spark, root, name)
    shutil.rmtree(os.path.join(root, name, "accounts"))
    with pytest.raises(RuntimeError, match="lacks accounts"):
        S.snapshot_restore(spark, root, name)
    assert S.latest_snapshot(spark, tempfile.mkdtemp(prefix="ll-none-")) is None
