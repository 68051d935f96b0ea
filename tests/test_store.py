"""The ledger store: changed rows only, latest row wins, crash before the commit, compaction and removal."""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from ledger_helpers import SF_SMALL, make_ledger, make_requests
from pyspark.sql import functions as F

from ledgerline import fixtures
from ledgerline.operators import posting as P
from ledgerline.sources import store as S

AS_OF = "2024-01-15 00:00:00"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _ledger(spark, n=60):
    accounts = [{"id": i, "account_number": f"KB{i:010d}", "balance": 100 * i} for i in range(1, n + 1)]
    return make_ledger(spark, accounts, [{"account_id": i, "amount": 500} for i in range(1, n + 1)])


def _requests(spark, day, accounts, start):
    return make_requests(spark, [
        (start + k, f"2024-01-{day:02d} 10:00:00", f"KB{a:010d}", "withdrawal" if k % 2 else "deposit", None, 10 + k)
        for k, a in enumerate(accounts)
    ])


def test_a_batch_writes_the_rows_it_changed_and_reads_equal_the_full_rewrite(spark, tmp_path):
    root = str(tmp_path)
    ledger = full = _ledger(spark)
    S.init_store(ledger, root, AS_OF)
    for n, accounts in enumerate((range(1, 11), range(5, 15), range(20, 30)), 1):
        requests = _requests(spark, n, accounts, 100 * n)
        out = P.post(requests, full, AS_OF)
        full = full.__class__(**{**full.__dict__, "accounts": out.accounts, "account_limits": out.account_limits})
        S.apply_updates(root, P.post(requests, S.read_store(spark, root), AS_OF), AS_OF)
        assert spark.read.parquet(f"{root}/state/accounts/delta={n}").count() == 10
        assert spark.read.parquet(f"{root}/state/account_limits/delta={n}").count() == 5
        now = S.read_store(spark, root)
        assert _rows(now.accounts) == _rows(full.accounts) and _rows(now.account_limits) == _rows(full.account_limits)
    assert _rows(S.read_store(spark, root, 0).accounts) == _rows(ledger.accounts)


def test_a_crash_before_the_commit_leaves_the_state_and_a_retry_overwrites(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    S.init_store(_ledger(spark), root, AS_OF)
    before = _rows(S.read_store(spark, root).accounts)
    out = P.post(_requests(spark, 1, range(1, 11), 100), S.read_store(spark, root), AS_OF)

    def crash(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(S, "_commit", crash)
        with pytest.raises(OSError):
            S.apply_updates(root, out, AS_OF)
    assert os.path.isdir(f"{root}/state/accounts/delta=1") and S.committed(spark, root) == 0
    now = S.read_store(spark, root)
    assert _rows(now.accounts) == before and now.transactions.count() == 0
    other = P.post(_requests(spark, 1, range(30, 33), 500), now, AS_OF)
    assert S.apply_updates(root, other, AS_OF) == 1
    changed = {r.id for r in spark.read.parquet(f"{root}/state/accounts/delta=1").collect()}
    assert changed == {30, 31, 32} and S.read_store(spark, root).transactions.count() == 3


def test_compaction_and_removal(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(S, "COMPACT_EVERY", 3)
    S.init_store(_ledger(spark), root, AS_OF)
    seen = {0: _rows(S.read_store(spark, root).accounts)}
    for n in range(1, 6):
        S.apply_updates(root, P.post(_requests(spark, n, range(n, n + 4), 100 * n), S.read_store(spark, root), AS_OF), AS_OF)
        seen[n] = _rows(S.read_store(spark, root).accounts)
    assert S._bases(spark, root, "accounts") == [0, 3] and S._parts(spark, root, "accounts", 5) == (3, [4, 5])
    for n, want in seen.items():  # every batch can still be read
        assert _rows(S.read_store(spark, root, n).accounts) == want
    os.makedirs(f"{root}/state/accounts/base=5")  # a compaction that did not finish
    assert _rows(S.read_store(spark, root).accounts) == seen[5]
    gone = {os.path.relpath(p, root) for p in S.sweep(spark, root, 4)}
    assert {"state/accounts/base=0", "state/accounts/delta=1", "state/accounts/delta=3", "state/account_limits/base=0"} <= gone
    assert _rows(S.read_store(spark, root, 4).accounts) == seen[4] and _rows(S.read_store(spark, root).accounts) == seen[5]
    with pytest.raises(RuntimeError, match="retention"):
        S.read_store(spark, root, 2)
    assert S.sweep(spark, root, 4) == []


def test_removed_rows_and_other_tables(spark, tmp_path):
    root = str(tmp_path)
    S.init_store(_ledger(spark, 5), root, AS_OF)
    accounts = S.read_store(spark, root).accounts
    S.apply_changes(spark, root, {"accounts": accounts.where("id = 2").withColumn("_gone", F.lit(True)),
                                  "users": S.read_store(spark, root).users.where("id = 1").withColumn("last_name", F.lit("New"))}, AS_OF)
    now = S.read_store(spark, root)
    assert {r.id for r in now.accounts.collect()} == {1, 3, 4, 5}
    assert {r.id: r.last_name for r in now.users.collect()}[1] == "New" and now.users.count() == 5
    S.apply_changes(spark, root, {"accounts": accounts.where("id = 2")}, AS_OF)  # the row comes back
    assert S.read_store(spark, root).accounts.count() == 5
    assert S.compact(spark, root) == ["users", "accounts"] and S.read_store(spark, root).accounts.count() == 5


def test_repeats_in_one_batch(spark):
    led = make_ledger(spark, [{"id": 1, "account_number": "KB0000000001", "balance": 100}, {"id": 2, "account_number": "KB0000000002", "balance": 0}])
    w = (7, "2024-01-01 10:00:00", "KB0000000001", "withdrawal", None, 30)
    rows = [w, w, (8, "2024-01-01 10:01:00", "KB0000000001", "deposit", None, 5), (9, "2024-01-01 10:02:00", "KB0000000001", "withdrawal", None, 1),
            (9, "2024-01-01 10:02:00", "KB0000000001", "withdrawal", None, 2), (None, "2024-01-01 10:03:00", "KB0000000001", "deposit", None, 50),
            (None, "2024-01-01 10:03:00", "KB0000000001", "deposit", None, 50), (10, None, "KB0000000001", "transfer", "KB0000000002", 10), (10, None, "KB0000000001", "transfer", "KB0000000002", 10)]
    out = P.post(make_requests(spark, rows), led, AS_OF)
    got = sorted(((r.request_id, r.accepted, r.reason) for r in out.results.collect()), key=str)
    assert got == sorted([(7, True, None), (8, True, None), (9, False, "duplicate_request"), (10, True, None),
                          (None, False, "request_id_missing"), (None, False, "request_id_missing")], key=str)
    assert {r.id: r.balance for r in out.accounts.collect()} == {1: Decimal("65.00"), 2: Decimal("10.00")}
    tx = out.transactions.select("id", "reference_number").collect()
    assert len(tx) == 4 == len({t.id for t in tx}) == len({t.reference_number for t in tx})


def test_random_repeats_equal_the_sequential_solver(spark):
    import random

    from sequential import solve

    rng = random.Random(4)
    accounts = [{"id": i, "account_number": f"KB{i:010d}", "balance": 50, "status": "active", "overdraft_limit": 20} for i in range(1, 6)]
    rows = []
    for i in range(150):
        a, b = rng.sample(range(1, 6), 2)
        op = rng.choice(["deposit", "withdrawal", "withdrawal", "transfer"])
        row = (i, f"2024-01-01 10:{rng.randrange(60):02d}:00", f"KB{a:010d}", op, f"KB{b:010d}" if op == "transfer" else None, rng.randint(1, 60))
        rows += [row] * rng.choice([1, 1, 1, 2, 5])
        if i % 13 == 0:
            rows.append((*row[:5], row[5] + 1))
    rng.shuffle(rows)
    bad = {r[0] for r in rows if r[0] % 13 == 0}
    names = ("request_id", "requested_at", "account_number", "op", "to_account", "amount")
    want, balances = solve([dict(zip(names, (*r[:5], Decimal(r[5])))) for r in set(rows) if r[0] not in bad], accounts)
    out = P.post(make_requests(spark, rows).repartition(5), make_ledger(spark, accounts), AS_OF)
    got = {r.request_id: (r.accepted, r.reason, r.new_balance) for r in out.results.collect()}
    assert got == want | {i: (False, "duplicate_request", None) for i in bad}
    assert {r.id: r.balance for r in out.accounts.collect()} == {k: Decimal(v).quantize(Decimal("0.01")) for k, v in balances.items()}


def test_stream_keeps_request_ids_for_good(spark, tmp_path):
    """Repeats in one file, after a restart and many batches later; other bodies under a known id."""
    from ledgerline.streaming import posting as X

    root, src = str(tmp_path / "store"), str(tmp_path / "requests")
    S.init_store(_ledger(spark, 3), root, AS_OF)
    first = (1, "2024-01-01 10:00:00", "KB0000000001", "withdrawal", None, 30)

    def send(name, rows, per_trigger=None):
        for k, part in enumerate(rows):
            make_requests(spark, part).coalesce(1).write.parquet(f"{src}/{name}-{k:03d}")
        X.stream_posting(spark, f"{src}/*", root, str(tmp_path / "ckpt"), AS_OF, per_trigger).awaitTermination()

    send("a", [[first, first, (2, "2024-01-01 10:01:00", "KB0000000002", "deposit", None, 5), (2, "2024-01-01 10:01:00", "KB0000000002", "deposit", None, 6)]])
    send("b", [[(100 + k, "2024-01-02 10:00:00", "KB0000000003", "deposit", None, 1)] for k in range(2)], 1)
    send("c", [[first], [(*first[:5], 31), (*first[:5], 32)], [(*first[:5], 31), first]], 1)
    got = sorted((r.request_id, r.accepted, r.reason) for r in X.posted_results(spark, root).collect() if r.request_id < 100)
    assert got == [(1, False, "duplicate_request"), (1, True, None), (2, False, "duplicate_request")]
    now = S.read_store(spark, root)
    assert {r.id: r.balance for r in now.accounts.collect()} == {1: Decimal("70.00"), 2: Decimal("200.00"), 3: Decimal("302.00")}
    assert now.transactions.count() == 3 == now.transactions.select("reference_number").distinct().count()


def test_fixture_store_equals_one_posting(spark, tmp_path):
    f = fixtures.build(spark, SF_SMALL)
    S.init_store(f.ledger, str(tmp_path), AS_OF)
    out = P.post(f["post_requests"], f.ledger, fixtures.AS_OF)
    S.apply_updates(str(tmp_path), out, AS_OF)
    now = S.read_store(spark, str(tmp_path))
    assert _rows(now.accounts) == _rows(out.accounts) and _rows(now.account_limits) == _rows(out.account_limits)


def test_the_marker_takes_its_ids_from_the_written_rows(spark, tmp_path):
    """A posting's transactions and audit rows are computed once a batch, for the write."""
    root, asked = str(tmp_path), []

    class Outcome:
        def __init__(self, out):
            self.out = out

        def __getattr__(self, name):
            asked.append(name)
            return getattr(self.out, name)

    S.init_store(_ledger(spark), root, AS_OF)
    out = P.post(_requests(spark, 1, range(1, 11), 100), S.read_store(spark, root), AS_OF)
    S.apply_updates(root, Outcome(out), AS_OF)
    assert asked.count("transactions") == asked.count("audit_logs") == 1
    marks, _ = S.last_commit(spark, root)
    most = [df.agg(F.max("id")).first()[0] for df in (out.transactions, out.audit_logs)]
    assert [marks.transactions, marks.audit_logs] == most and None not in most
    # a batch without an accepted request keeps the marks
    S.apply_updates(root, P.post(make_requests(spark, [(900, "2024-01-02 10:00:00", "KB9", "deposit", None, 1)]), S.read_store(spark, root), AS_OF), AS_OF)
    assert S.last_commit(spark, root)[0] == marks
