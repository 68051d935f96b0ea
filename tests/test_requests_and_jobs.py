"""Request parsing and validation vectors of the reference tests, and the
fixture counts the jobs must reproduce."""

from __future__ import annotations

from ledger_helpers import SF_MID, SF_SMALL

from ledgerline import fixtures
from ledgerline.operators import aggregates as A
from ledgerline.operators import jobs as JB
from ledgerline.operators import validation as V
from ledgerline.sources import requests as R

AS_OF = fixtures.AS_OF


def _validate(spark, bodies, kind):
    raw = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    if kind == "transaction":
        return {r.request_id: r.reason for r in V.validate_transaction_requests(R.read_requests(raw)).collect()}
    if kind == "transfer":
        return {r.request_id: r.reason for r in
                V.validate_transfer_requests(R.read_requests(raw, schema=R.TRANSFER_BODY)).collect()}
    return {r.request_id: r.reason for r in V.validate_account_requests(R.read_requests(raw, schema=R.ACCOUNT_BODY)).collect()}


def test_transaction_request_vectors(spark):
    got = _validate(spark, [
        '{"accountNumber":"KB1234567890","type":"deposit","amount":500,"description":"x"}',
        '{"invalid json}',
        '{"accountNumber":"INVALID123","type":"deposit","amount":100}',
        '{"accountNumber":"KB1234567890","type":"invalid_type","amount":100}',
        '{"accountNumber":"KB1234567890","type":"deposit","amount":-100}',
        '{"accountNumber":"KB1234567890","type":"deposit","amount":"100"}',
        '{"accountNumber":"KB1234567890","type":"deposit"}',
    ], "transaction")
    assert got == {0: None, 1: "invalid_json", 2: "invalid_account_number", 3: "invalid_type",
                   4: "invalid_amount", 5: "invalid_amount", 6: "missing_fields"}


def test_transfer_and_account_vectors(spark):
    t = _validate(spark, [
        '{"fromAccount":"KB1","toAccount":"KB2","amount":750,"description":"rent"}',
        '{"fromAccount":"KB1","toAccount":"KB1","amount":10}',
        '{"fromAccount":"KB1","toAccount":"KB2","amount":0}',
    ], "transfer")
    assert t == {0: None, 1: "same_account", 2: "invalid_amount"}
    a = _validate(spark, [
        '{"firstName":"A","lastName":"B","email":"a@b.co","initialDeposit":1000}',
        '{"firstName":"A","lastName":"B","email":"invalid-email"}',
        '{"firstName":"A","email":"a@b.co"}',
        '{"firstName":"A","lastName":"B","email":"a@b.co","initialDeposit":-5}',
    ], "account")
    assert a == {0: None, 1: "invalid_email", 2: "missing_fields", 3: "invalid_initial_deposit"}


def test_fixture_counts_sf001(spark):
    f = fixtures.build(spark, SF_MID)
    led = f.ledger
    assert JB.reset_count(led.account_limits, AS_OF).collect()[0].reset_count == 2000
    expired = JB.expire_sessions(led.sessions, AS_OF)
    before = led.sessions.where("is_active").count()
    assert before - expired.where("is_active").count() == 702
    assert A.balance_reconciliation(led).count() == 1499


def test_create_and_close_accounts(spark):
    f = fixtures.build(spark, SF_SMALL)
    created = JB.create_accounts(f["create_requests"], f.ledger, AS_OF)
    res = created.results.collect()
    assert sum(1 for r in res if r.reason == "user_not_found") == 1
    ok = [r for r in res if r.accepted]
    assert all(r.account_number.startswith("KB20240115000000") for r in ok)
    assert created.account_limits.count() == 3 * len(ok)
    assert created.audit_logs.count() == len(ok)
    closed = JB.close_accounts(f.ledger.accounts.selectExpr("id AS request_id", "account_number",
                                                            "CAST(NULL AS STRING) AS reason"), f.ledger, AS_OF)
    n_ok = closed.results.where("accepted").count()
    assert n_ok == closed.audit_logs.count() > 0
    assert closed.accounts.where("status = 'closed' AND closed_at IS NOT NULL").count() >= n_ok


def test_request_log_files_round_trip(spark):
    import os
    import tempfile

    f = fixtures.build(spark, SF_SMALL)
    log = f["request_log"]
    path = os.path.join(tempfile.mkdtemp(prefix="ll-log-"), "log")
    R.request_log_lines(log).write.text(path)  # one JSON object per line
    back = R.read_request_log(spark, path=path)
    cols = ["ts", "method", "route", "status_code", "duration_s", "ip"]
    assert sorted(back.select(*cols).collect()) == sorted(log.select(*cols).collect())


def test_api_account_creation_and_repeated_close(spark):
    f = fixtures.build(spark, SF_SMALL)
    created = JB.create_accounts(f["create_requests"], f.ledger, AS_OF, rules="api")
    assert created.account_limits.count() == 0 and created.audit_logs.count() == 0
    zero = [r.account_number for r in f.ledger.accounts.where("status = 'active' AND balance = 0").collect()]
    busy = [r.account_number for r in f.ledger.accounts.where("status = 'active' AND balance <> 0").limit(1).collect()]
    req = spark.createDataFrame(
        [(1, zero[0], None), (2, zero[0], None), (3, busy[0], None), (4, busy[0], None)],
        "request_id long, account_number string, reason string")
    got = {r.request_id: r.reason for r in JB.close_accounts(req, f.ledger, AS_OF).results.collect()}
    assert got == {1: None, 2: "account_not_found", 3: "non_zero_balance", 4: "non_zero_balance"}
