"""Request bodies as a stream: dead letters once, corrected bodies post, both sinks under one commit."""

from __future__ import annotations

import json
import os

import pytest
from ledger_helpers import make_ledger

from ledgerline.sources import requests as R
from ledgerline.sources import store as S
from ledgerline.streaming import posting as XP

AS_OF = "2024-01-15 00:00:00"
GOOD = {"accountNumber": "KB0000000001", "type": "withdrawal", "amount": 30}


def _line(rid, body, path=R.TRANSACTIONS_PATH, at="2024-01-10T10:00:00"):
    return json.dumps({"requestId": rid, "requestedAt": at, "path": path, "body": body if isinstance(body, str) else json.dumps(body)})


def _transfer(source, to, amount):
    return {"fromAccount": source, "toAccount": to, "amount": amount}


CASES = [
    (_line(1, GOOD), None), (_line(2, dict(GOOD, type="deposit", amount=5.25)), None),
    (_line(3, _transfer("KB0000000001", "KB0000000002", 7), R.TRANSFERS_PATH), None),
    (json.dumps({"requestId": 4, "requestedAt": "2024-01-10 10:00:01", "path": R.TRANSACTIONS_PATH, "body": GOOD}), None),
    ("", "invalid_envelope"), ("not json", "invalid_envelope"), ("[1, 2]", "invalid_envelope"),
    (_line(None, GOOD), "invalid_envelope"), (_line(5, GOOD, at="yesterday"), "invalid_envelope"),
    (_line(6, GOOD, path="/api/other"), "unknown_path"), (_line(6, GOOD, path=None), "unknown_path"),
    (_line(7, '{"accountNumber":'), "invalid_json"), (_line(8, "[]"), "invalid_json"), (_line(9, ""), "invalid_json"),
    (_line(10, {"type": "deposit", "amount": 1}), "missing_fields"),
    (_line(11, dict(GOOD, accountNumber="X1")), "invalid_account_number"),
    (_line(12, dict(GOOD, amount="30")), "invalid_amount"), (_line(13, dict(GOOD, amount=0)), "invalid_amount"),
    (_line(14, dict(GOOD, type="loan")), "invalid_type"),
    (_line(15, _transfer("KB0000000001", "KB0000000001", 7), R.TRANSFERS_PATH), "same_account"),
    (_line(16, dict(GOOD, description="x" * 200_000, amount=-1)), "invalid_amount"),
]


def test_each_line_has_its_first_failure(spark):
    lines = spark.createDataFrame([(line,) for line, _ in CASES], "value string")
    got = {r.line: r for r in R.posting_requests(lines).collect()}
    assert {line: got[line].reason for line, _ in CASES} == dict(CASES)
    transfer = got[CASES[2][0]]
    assert (transfer.op, transfer.account_number, transfer.to_account, float(transfer.amount)) == (
        "transfer", "KB0000000001", "KB0000000002", 7.0)
    assert R.posting_requests(lines.limit(0)).count() == 0


@pytest.fixture
def folders(spark, tmp_path):
    accounts = [{"id": i, "account_number": f"KB{i:010d}", "balance": 100} for i in (1, 2)]
    root = str(tmp_path / "store")
    S.init_store(make_ledger(spark, accounts), root, AS_OF)
    (tmp_path / "lines").mkdir()
    return str(tmp_path), root


def _send(spark, folders, name, lines):
    base, root = folders
    with open(os.path.join(base, "lines", name), "w") as out:
        out.write("\n".join(lines) + "\n")
    XP.stream_bodies(spark, os.path.join(base, "lines"), root, os.path.join(base, "ckpt"), AS_OF).awaitTermination()


def _balances(spark, root):
    return {r.id: float(r.balance) for r in S.read_store(spark, root).accounts.collect()}


def test_dead_letters_come_once_and_a_corrected_body_posts(spark, folders):
    root = folders[1]
    lines = [line for line, _ in CASES]
    _send(spark, folders, "a", lines + lines)
    assert _balances(spark, root) == {1: 100 - 30 + 5.25 - 7 - 30, 2: 107}
    bad = sorted((line, reason) for line, reason in CASES if reason)
    assert sorted((r.line, r.reason) for r in XP.rejected_lines(spark, root).collect()) == bad
    # after a restart: the same lines (nothing happens), and a corrected body under a rejected id
    _send(spark, folders, "b", [*lines, _line(7, dict(GOOD, type="deposit", amount=1))])
    assert _balances(spark, root) == {1: 100 - 30 + 5.25 - 7 - 30 + 1, 2: 107}
    assert sorted((r.line, r.reason) for r in XP.rejected_lines(spark, root).collect()) == bad
    assert sorted(r.request_id for r in XP.posted_results(spark, root).collect()) == [1, 2, 3, 4, 7]
    # another body under a posted id
    _send(spark, folders, "c", [_line(1, dict(GOOD, amount=31))])
    assert [r.reason for r in XP.posted_results(spark, root).where("request_id = 1 AND NOT accepted").collect()] == ["duplicate_request"]


def test_results_and_dead_letters_appear_together(spark, folders, monkeypatch):
    root = folders[1]

    def crash(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(S, "_commit", crash)
        with pytest.raises(Exception, match="lost before the commit"):
            _send(spark, folders, "a", [CASES[0][0], "not json"])
    assert S.committed(spark, root) == 0
    assert XP.posted_results(spark, root).count() == XP.rejected_lines(spark, root).count() == 0
    _send(spark, folders, "b", ["not json"])
    assert _balances(spark, root) == {1: 70, 2: 100}
    assert [r.line for r in XP.rejected_lines(spark, root).collect()] == ["not json"]
