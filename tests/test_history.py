"""Balances as of a time from checkpoints: equal to the replay, late rows, crash, and folders that are never read."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from ledger_helpers import make_ledger, make_requests

from ledgerline.operators import posting as P
from ledgerline.operators import windows as W
from ledgerline.sources import history as H
from ledgerline.sources import store as S

AS_OF = "2024-01-15 00:00:00"
SCHEMA = "id long, account_id long, created_at timestamp, balance_after decimal(15,2), other string"
START = datetime(2022, 11, 20)


def _posted(spark, n=300, seed=1):
    """Rows of two years: a third on one account, equal times, no time, no balance, a gap of a year."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        day = rnd.randrange(120) if i % 2 else rnd.randrange(500, 620)
        at = START + timedelta(days=day, hours=rnd.randrange(3))
        rows.append((i, 1 if i % 3 == 0 else rnd.randrange(2, 12), None if i % 50 == 7 else at,
                     None if i % 40 == 3 else Decimal(rnd.randrange(10**6)) / 100, "x"))
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TIMES = ["2022-01-01 00:00:00", "2022-11-20 00:00:00", "2022-12-31 23:59:59", "2023-01-01 00:00:00", "2023-02-10 01:00:00",
         "2023-10-05 00:00:00", "2024-05-01 00:00:00", "2030-01-01 00:00:00"]


def test_any_order_of_batches_equals_the_replay(spark, tmp_path):
    posted = _posted(spark).cache()
    cuts = {
        "one": ["true"], "late": ["id % 3 = 0", "id % 3 = 1", "id % 3 = 2"],
        "in order": ["created_at < '2023-02-01'", "created_at >= '2023-02-01' OR created_at IS NULL"],
        "backwards": ["created_at >= '2024-05-01' OR created_at IS NULL", "false", "created_at < '2023-01-05'",
                      "created_at >= '2023-01-05' AND created_at < '2024-05-01'"],
    }
    want = {at: _rows(W.balance_as_of(posted, at).select("account_id", "balance")) for at in TIMES}
    for name, parts in cuts.items():
        root = str(tmp_path / name.replace(" ", "-"))
        for part in parts:
            H.append(posted.where(part), root, months=1)
        for at in TIMES if name != "one" else TIMES[::3]:
            assert _rows(H.balance_as_of(spark, root, at)) == want[at], (name, at)


def test_points_equal_the_replay(spark, tmp_path):
    posted = _posted(spark, seed=2).cache()
    for part in range(2):
        H.append(posted.where(f"id % 2 = {part}"), str(tmp_path), months=1)
    rnd = random.Random(3)
    points = [(rnd.choice([1, 1, 1, *range(2, 14)]), START + timedelta(days=rnd.randrange(-40, 700))) for _ in range(150)]
    points += [points[0], (None, START), (1, None), (99, START + timedelta(days=600))]
    rows = [r for r in posted.collect() if r.created_at]

    def balance(account, at):
        seen = [(r.created_at, r.id, r.balance_after) for r in rows if at and r.account_id == account and r.created_at <= at]
        return max(seen, key=lambda r: r[:2])[2] if seen else None

    want = sorted(((a, t, balance(a, t)) for a, t in points), key=str)
    frame = spark.createDataFrame(points, "account_id long, at timestamp")
    for target in (2_000_000, 40):  # one chunk, and many whose ends carry over
        assert _rows(H.balances_at(spark, str(tmp_path), frame, target_rows=target)) == want


def test_only_the_checkpoint_and_its_period_are_read(spark, tmp_path):
    posted, root = _posted(spark), str(tmp_path)
    H.append(posted, root, months=1)
    want = _rows(W.balance_as_of(posted, TIMES[6]).select("account_id", "balance"))
    period = (2024 * 12 + 4)
    broken = 0
    for kind in ("rows", "checkpoints"):
        for folder, _, files in os.walk(os.path.join(root, kind)):
            for f in files:
                if f.endswith(".parquet") and not folder.endswith(f"period={period}"):
                    with open(os.path.join(folder, f), "wb") as out:
                        out.write(b"not a table")
                    crc = os.path.join(folder, f".{f}.crc")
                    broken += 1
                    assert os.path.exists(crc)
    assert broken > 10 and _rows(H.balance_as_of(spark, root, TIMES[6])) == want


def test_a_crash_before_the_commit_and_an_empty_history(spark, tmp_path, monkeypatch):
    posted, root = _posted(spark, 60), str(tmp_path)
    assert H.balance_as_of(spark, root, AS_OF).count() == 0
    assert H.append(posted.limit(0), root, months=1) == 0
    assert H.balance_as_of(spark, root, AS_OF).count() == 0
    points = spark.createDataFrame([(1, START)], "account_id long, at timestamp")
    assert [r.balance for r in H.balances_at(spark, root, points).collect()] == [None]

    def crash(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(H, "discard", crash)
        with pytest.raises(OSError):
            H.append(posted, root)
    assert H.balance_as_of(spark, root, TIMES[-1]).count() == 0
    half = posted.where("id < 30")
    assert H.append(half, root) == 1  # the retry overwrites
    assert H.append(posted, root, batch=1) == 1  # known already: nothing happens
    assert _rows(H.balance_as_of(spark, root, TIMES[-1])) == _rows(W.balance_as_of(half, TIMES[-1]).select("account_id", "balance"))


def test_the_history_follows_the_store(spark, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "history")
    S.init_store(make_ledger(spark, [{"id": i, "account_number": f"KB{i:010d}", "balance": 100} for i in (1, 2, 3)]), store, AS_OF)
    for n, month in enumerate((1, 2, 5), 1):
        out = P.post(make_requests(spark, [(10 * n + a, f"2024-{month:02d}-03 10:00:00", f"KB{a:010d}", "deposit", None, n)
                                           for a in ((1, 2) if n < 3 else (3,))]), S.read_store(spark, store), AS_OF)
        S.apply_updates(store, out, AS_OF)
        if n != 2:  # the third call takes two batches
            assert H.follow(spark, store, root, months=1) == n
    facts = S.read_store(spark, store).transactions
    for at in ("2024-01-20 00:00:00", "2024-03-01 00:00:00", "2024-06-01 00:00:00"):
        assert _rows(H.balance_as_of(spark, root, at)) == _rows(W.balance_as_of(facts, at).select("account_id", "balance"))
