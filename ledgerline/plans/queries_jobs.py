"""Registered ledger jobs: ordered posting (T1-T4) and the stateless jobs,
data-quality rules and streams (inventory sections 2.8-2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import posting as T
from .catalog import AS_OF, fx, register

_LIMIT_SQL = f"""(SELECT account_id, amount, current_usage,
    row_number() OVER (PARTITION BY account_id ORDER BY id) AS rn FROM account_limits
  WHERE limit_type = 'daily_withdrawal' AND (reset_at IS NULL OR reset_at > TIMESTAMP '{AS_OF}'))"""
_TX_BASE = "((SELECT COALESCE(MAX(id), 0) FROM transactions) + 1)"


def _posted(spark, sf_dir, op=None):
    f = fx(spark, sf_dir)
    req = f["post_requests"]
    if op is not None:
        req = req.where(F.col("op") == op)
    return T.post(req, f.ledger, AS_OF)


@register("post_deposits", views=("accounts", "transactions", "post_requests"), oracle=f""",
chk AS (
  SELECT r.request_id, r.requested_at, r.amount, a.id AS acct, a.balance,
    CASE WHEN a.id IS NULL THEN 'account_not_found' WHEN r.amount IS NULL THEN 'amount_missing'
         WHEN r.amount <= 0 THEN 'invalid_amount' END AS reason
  FROM post_requests r LEFT JOIN accounts a ON a.account_number = r.account_number AND a.status = 'active'
  WHERE r.op = 'deposit')
SELECT request_id, 'deposit' AS op, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN CAST(balance + SUM(CASE WHEN reason IS NULL THEN amount ELSE 0 END)
    OVER (PARTITION BY acct ORDER BY requested_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS DECIMAL(15,2)) END AS new_balance,
  CASE WHEN reason IS NULL THEN {_TX_BASE} + 2 * request_id END AS transaction_id
FROM chk""")
def q_post_deposits(spark, sf_dir):
    """Deposits of the request table, posted in order."""
    return _posted(spark, sf_dir, "deposit").results


@register("post_withdrawals", views=("accounts", "transactions", "post_requests", "account_limits"),
          recursive=True, oracle=f""",
chk AS (
  SELECT r.request_id, r.requested_at, r.amount, a.id AS acct, a.balance, COALESCE(a.overdraft_limit, 0) AS od,
    l.amount AS lim, COALESCE(l.current_usage, 0) AS use0,
    CASE WHEN a.id IS NULL THEN 'account_not_found' WHEN r.amount IS NULL THEN 'amount_missing'
         WHEN r.amount <= 0 THEN 'invalid_amount' END AS sreason
  FROM post_requests r LEFT JOIN accounts a ON a.account_number = r.account_number AND a.status = 'active'
  LEFT JOIN {_LIMIT_SQL} l ON l.account_id = a.id AND l.rn = 1
  WHERE r.op = 'withdrawal'),
v AS (SELECT *, row_number() OVER (PARTITION BY acct ORDER BY requested_at, request_id) AS pos
      FROM chk WHERE sreason IS NULL),
walk(acct, pos, bal, used, request_id, reason) AS (
  SELECT DISTINCT acct, CAST(0 AS BIGINT), CAST(balance AS DECIMAL(38,2)), CAST(use0 AS DECIMAL(38,2)),
    CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM v
  UNION ALL
  SELECT v.acct, v.pos,
    CASE WHEN w.bal - v.amount >= -v.od AND (v.lim IS NULL OR w.used + v.amount <= v.lim)
         THEN w.bal - v.amount ELSE w.bal END,
    CASE WHEN w.bal - v.amount >= -v.od AND (v.lim IS NULL OR w.used + v.amount <= v.lim)
         THEN w.used + v.amount ELSE w.used END,
    v.request_id,
    CASE WHEN w.bal - v.amount < -v.od THEN 'insufficient_funds'
         WHEN v.lim IS NOT NULL AND w.used + v.amount > v.lim THEN 'daily_limit_exceeded' END
  FROM walk w JOIN v ON v.acct = w.acct AND v.pos = w.pos + 1)
SELECT c.request_id, 'withdrawal' AS op, COALESCE(c.sreason, w.reason) IS NULL AS accepted,
  COALESCE(c.sreason, w.reason) AS reason,
  CASE WHEN COALESCE(c.sreason, w.reason) IS NULL THEN CAST(w.bal AS DECIMAL(15,2)) END AS new_balance,
  CASE WHEN COALESCE(c.sreason, w.reason) IS NULL THEN {_TX_BASE} + 2 * c.request_id END AS transaction_id
FROM chk c LEFT JOIN walk w ON w.request_id = c.request_id""")
def q_post_withdrawals(spark, sf_dir):
    """Withdrawals with overdraft floor and daily limit, posted in order."""
    return _posted(spark, sf_dir, "withdrawal").results


def _walked(requests: str) -> str:
    """CTEs that post a mixed batch one request at a time: ``walk`` carries every
    account's balance and limit usage (in cents) as lists from request to request.
    ``requests``: a SELECT of request_id, requested_at, account_number, op, to_account, amount."""
    return f""",
acc AS (SELECT id, account_number, user_id, status, balance, COALESCE(overdraft_limit, 0) AS od, row_number() OVER (ORDER BY id) AS ix
        FROM accounts),
lim AS (SELECT acc.ix, l.amount, l.current_usage, l.account_id FROM acc LEFT JOIN {_LIMIT_SQL} l ON l.account_id = acc.id AND l.rn = 1),
req AS ({requests}),
chk AS (
  SELECT r.*, s.id AS src, d.id AS dst, s.ix AS s, d.ix AS d, CAST(s.od * 100 AS BIGINT) AS od, d.user_id AS dst_user,
    CAST(CASE WHEN r.op = 'withdrawal' THEN l.amount END * 100 AS BIGINT) AS cap, CAST(r.amount * 100 AS BIGINT) AS cents,
    CASE WHEN r.op IN ('deposit', 'withdrawal') THEN
        CASE WHEN s.id IS NULL THEN 'account_not_found' WHEN r.amount IS NULL THEN 'amount_missing'
             WHEN r.amount <= 0 THEN 'invalid_amount' END
      WHEN r.op = 'transfer' THEN
        CASE WHEN r.account_number = r.to_account THEN 'same_account' WHEN r.amount IS NULL THEN 'amount_missing'
             WHEN r.amount <= 0 THEN 'invalid_amount' WHEN s.id IS NULL THEN 'source_not_found'
             WHEN d.id IS NULL THEN 'destination_not_found' END
      ELSE 'invalid_type' END AS sreason
  FROM req r LEFT JOIN acc s ON s.account_number = r.account_number AND s.status = 'active'
  LEFT JOIN acc d ON r.op = 'transfer' AND d.account_number = r.to_account AND d.status = 'active'
  LEFT JOIN lim l ON l.ix = s.ix),
v AS (SELECT *, row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id) AS pos FROM chk WHERE sreason IS NULL),
walk(pos, bals, uses, request_id, why, before0, before1) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(CAST(balance * 100 AS BIGINT) ORDER BY ix) FROM acc),
    (SELECT list(CAST(COALESCE(current_usage, 0) * 100 AS BIGINT) ORDER BY ix) FROM lim),
    CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT pos, CASE WHEN why IS NOT NULL THEN bals WHEN op = 'deposit' THEN list_transform(bals, lambda b, i: CASE WHEN i = s THEN b + cents ELSE b END)
      ELSE list_transform(bals, lambda b, i: CASE WHEN i = s THEN b - cents WHEN i = d THEN b + cents ELSE b END) END,
    CASE WHEN why IS NULL AND op = 'withdrawal' THEN list_transform(uses, lambda b, i: CASE WHEN i = s THEN b + cents ELSE b END) ELSE uses END,
    request_id, why, bals[s], bals[d]
  FROM (SELECT v.*, w.bals, w.uses, CASE
      WHEN v.op = 'withdrawal' AND w.bals[v.s] - v.cents < -v.od THEN 'insufficient_funds'
      WHEN v.op = 'withdrawal' AND w.uses[v.s] + v.cents > v.cap THEN 'daily_limit_exceeded'
      WHEN v.op = 'transfer' AND w.bals[v.s] < v.cents THEN 'insufficient_funds' END AS why
    FROM walk w JOIN v ON v.pos = w.pos + 1)),
done AS (SELECT c.*, COALESCE(c.sreason, w.why) AS reason, w.before0, w.before1,
    {_TX_BASE} + 2 * c.request_id AS tx FROM chk c LEFT JOIN walk w ON w.request_id = c.request_id),
legs AS (
  SELECT tx AS id, request_id, requested_at, op, src AS account_id, CASE WHEN op = 'deposit' THEN 'deposit' ELSE 'withdrawal' END AS type, amount,
    before0 AS b, before0 + CASE WHEN op = 'deposit' THEN cents ELSE -cents END AS a, dst AS other FROM done WHERE reason IS NULL
  UNION ALL
  SELECT tx + 1, request_id, requested_at, op, dst, 'deposit', amount, before1, before1 + cents, src FROM done WHERE reason IS NULL AND op = 'transfer')
"""


def _cents(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(20,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(15,2))"


_REQ_SQL = "SELECT request_id, requested_at, account_number, op, to_account, amount FROM post_requests"
_RESULT_SQL = f"""SELECT request_id, op, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN {_cents("before0 + CASE WHEN op = 'deposit' THEN cents ELSE -cents END")} END AS new_balance,
  CASE WHEN reason IS NULL THEN tx END AS transaction_id FROM done"""
_POST_VIEWS = ("accounts", "transactions", "post_requests", "account_limits")


@register("post_transfers", views=_POST_VIEWS, recursive=True, oracle=_walked(f"{_REQ_SQL} WHERE op = 'transfer'") + _RESULT_SQL)
def q_post_transfers(spark, sf_dir):
    """Transfers (two legs each, coupled accounts), posted in order."""
    return _posted(spark, sf_dir, "transfer").results


@register("post_mixed", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + _RESULT_SQL)
def q_post_mixed(spark, sf_dir):
    """T4: deposits, withdrawals and transfers in one ordered batch; the results."""
    return _posted(spark, sf_dir).results


#: The fixture's requests, some sent again as they are and some with another amount under the same id.
_KEPT_SQL = f"{_REQ_SQL} WHERE request_id % 11 <> 0"
_REPEATED_RESULT_SQL = _RESULT_SQL + """ UNION ALL SELECT request_id, op, false, 'duplicate_request',
  CAST(NULL AS DECIMAL(15,2)), CAST(NULL AS BIGINT) FROM post_requests WHERE request_id % 11 = 0"""


def _repeated(requests):
    again = requests.where("request_id % 7 = 0 OR request_id % 11 = 0")
    other = F.when(F.col("request_id") % 11 == 0, F.coalesce("amount", F.lit(0)) + 1).otherwise(F.col("amount"))
    return again.withColumn("amount", other.cast(schemas.MONEY))


@register("post_repeated", views=_POST_VIEWS, recursive=True, oracle=_walked(_KEPT_SQL) + _REPEATED_RESULT_SQL)
def q_post_repeated(spark, sf_dir):
    """T4 on a request table with repeats: equal ones post once, different bodies under one id post neither."""
    f = fx(spark, sf_dir)
    requests = f["post_requests"]
    return T.post(requests.unionByName(_repeated(requests)).unionByName(_repeated(requests)), f.ledger, AS_OF).results


@register("post_mixed_transactions", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + f"""
SELECT id, account_id, type, amount, {_cents("b")} AS balance_before, {_cents("a")} AS balance_after, 'completed' AS status,
  CASE WHEN op = 'transfer' THEN other END AS related_account_id,
  CASE WHEN op = 'transfer' AND type = 'deposit' THEN id - 1 END AS related_transaction_id, requested_at AS created_at FROM legs""")
def q_post_mixed_transactions(spark, sf_dir):
    """T4: the transaction rows that the mixed batch posts."""
    return _posted(spark, sf_dir).transactions.select(
        "id", "account_id", "type", "amount", "balance_before", "balance_after", "status", "related_account_id",
        "related_transaction_id", "created_at")


@register("post_mixed_accounts", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + f"""
SELECT acc.id, {_cents("w.bals[acc.ix]")} AS balance, m.t AS posted_at
FROM acc, (SELECT bals FROM walk ORDER BY pos DESC LIMIT 1) w
LEFT JOIN (SELECT account_id, max(requested_at) AS t FROM legs GROUP BY 1) m ON m.account_id = acc.id""")
def q_post_mixed_accounts(spark, sf_dir):
    """T4: every account's balance after the mixed batch, and the time of its last posting."""
    f = fx(spark, sf_dir)
    before = f.ledger.accounts.select("id", F.col("updated_at").alias("old"))
    after = T.post(f["post_requests"], f.ledger, AS_OF).accounts.join(before, "id")
    return after.select("id", "balance", F.when(~F.col("updated_at").eqNullSafe(F.col("old")), F.col("updated_at")).alias("posted_at"))


@register("post_mixed_limits", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + """
SELECT l.id, l.account_id, l.limit_type, CAST(COALESCE(l.current_usage, 0) + COALESCE(u.used, 0) AS DECIMAL(15,2)) AS current_usage
FROM account_limits l LEFT JOIN (SELECT account_id, sum(amount) AS used FROM legs WHERE op = 'withdrawal' GROUP BY 1) u
  ON u.account_id = l.account_id AND l.limit_type = 'daily_withdrawal'""")
def q_post_mixed_limits(spark, sf_dir):
    """T4: the limit usage after the mixed batch."""
    return _posted(spark, sf_dir).account_limits.select(
        "id", "account_id", "limit_type", F.coalesce("current_usage", F.lit(0)).cast("decimal(15,2)").alias("current_usage"))


_RECEIVED = """'transfer_received' AS type, 'info' AS severity, 'Transfer Received' AS title,
  'You received $' || CAST(amount AS VARCHAR) || ' from account ' || account_number AS message"""


@register("post_mixed_alerts", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + f"""
SELECT l.id, acc.user_id, l.account_id, CASE WHEN l.op = 'deposit' THEN 'large_transaction'
    WHEN l.op = 'withdrawal' THEN 'low_balance' ELSE 'transfer_received' END AS type, l.requested_at AS created_at
FROM legs l JOIN acc ON acc.id = l.account_id
WHERE (l.op = 'deposit' AND l.amount > 10000) OR (l.op = 'withdrawal' AND l.a < 10000) OR (l.op = 'transfer' AND l.type = 'deposit')""")
def q_post_mixed_alerts(spark, sf_dir):
    """T4: the alerts that the mixed batch raises."""
    return _posted(spark, sf_dir).alerts.select("id", "user_id", "account_id", "type", "created_at")


@register("post_mixed_audit", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + f"""
SELECT l.id - {_TX_BASE} + 1 AS id, l.account_id, 'balance_change' AS action,
  '{{"balance":' || CAST({_cents("l.b")} AS VARCHAR) || ',"updated_at":' || COALESCE('"' || strftime(CASE WHEN l.nth = 1 THEN l.updated_at
    ELSE l.prev END, '%Y-%m-%dT%H:%M:%S.%g') || '"', 'null') || '}}' AS old_values,
  '{{"balance":' || CAST({_cents("l.a")} AS VARCHAR) || ',"updated_at":' || COALESCE('"' || strftime(l.requested_at, '%Y-%m-%dT%H:%M:%S.%g') || '"', 'null')
    || '}}' AS new_values, l.requested_at AS created_at
FROM (SELECT legs.*, x.updated_at, lag(requested_at) OVER w AS prev, row_number() OVER w AS nth FROM legs JOIN accounts x ON x.id = legs.account_id
      WINDOW w AS (PARTITION BY account_id ORDER BY requested_at NULLS FIRST, request_id, legs.id)) l""")
def q_post_mixed_audit(spark, sf_dir):
    """T4: the balance_change audit rows of the mixed batch (the ledger has none before)."""
    return _posted(spark, sf_dir).audit_logs.select("id", "account_id", "action", "old_values", "new_values", "created_at")


# --------------------------------------------------------------------------- stateless jobs
from ..functions import expressions as X  # noqa: E402
from ..operators import jobs as JB  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from ..operators import reads as P  # noqa: E402
from ..operators import validation as V  # noqa: E402
from ..operators import windows as W  # noqa: E402
from ..sources import requests as R  # noqa: E402
from .catalog import POINT_IN_TIME, SIGNED_SQL  # noqa: E402
from .queries_core import RUNNING_SQL  # noqa: E402

_ACC_BASE = "((SELECT COALESCE(MAX(id), 0) FROM accounts) + 1)"
_SEQ = ("CASE WHEN length(CAST(r.request_id AS VARCHAR)) >= 4 THEN CAST(r.request_id AS VARCHAR) "
        "ELSE lpad(CAST(r.request_id AS VARCHAR), 4, '0') END")


@register("create_accounts", views=("users", "accounts", "create_requests"), oracle=f"""
SELECT request_id, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN {_ACC_BASE} + request_id END AS account_id,
  CASE WHEN reason IS NULL THEN number END AS account_number,
  CASE WHEN reason IS NULL THEN CAST(COALESCE(initial_balance, 0) AS DECIMAL(15,2)) END AS balance
FROM (SELECT r.request_id, r.initial_balance,
        CASE WHEN u.id IS NULL THEN 'user_not_found' WHEN COALESCE(r.initial_balance, 0) < 0
             THEN 'negative_initial_balance' END AS reason,
        'KB' || strftime(TIMESTAMP '{AS_OF}', '%Y%m%d%H%M%S') || {_SEQ} AS number
      FROM create_requests r LEFT JOIN (SELECT DISTINCT id FROM users) u ON u.id = r.user_id)""")
def q_create_accounts(spark, sf_dir):
    """T5: open an account per creation request."""
    f = fx(spark, sf_dir)
    return JB.create_accounts(f["create_requests"], f.ledger, AS_OF).results


@register("open_accounts", views=("users", "accounts", "create_requests"), oracle=f"""
SELECT request_id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN user_id END AS user_id,
  CASE WHEN reason IS NULL THEN {_ACC_BASE} + request_id END AS account_id,
  CASE WHEN reason IS NULL THEN 'KB' || strftime(TIMESTAMP '{AS_OF}', '%Y%m%d%H%M%S') || {_SEQ.replace("r.request_id", "request_id")} END AS account_number,
  CASE WHEN reason IS NULL THEN CAST(COALESCE(deposit, 0) AS DECIMAL(15,2)) END AS balance
FROM (SELECT request_id, deposit, (SELECT COALESCE(MAX(id), 0) + 1 FROM users) + request_id AS user_id,
    CASE WHEN why IS NOT NULL THEN why WHEN email IN (SELECT email FROM users WHERE email IS NOT NULL)
      OR row_number() OVER (PARTITION BY email, why ORDER BY request_id) > 1 THEN 'duplicate_email' END AS reason
  FROM (SELECT q.*, CASE
      WHEN COALESCE(first_name, '') = '' OR COALESCE(last_name, '') = '' OR COALESCE(email, '') = '' THEN 'missing_fields'
      WHEN NOT regexp_matches(email, '{X.EMAIL_API_RULE}') THEN 'invalid_email' WHEN deposit < 0 THEN 'invalid_initial_deposit' END AS why
    FROM (SELECT r.request_id, u.first_name, u.last_name, r.initial_balance AS deposit,
        CASE WHEN r.request_id % 3 = 0 THEN u.email ELSE 'new' || (r.user_id // 2) || '@example.com' END AS email
      FROM create_requests r LEFT JOIN users u ON u.id = r.user_id) q))""")
def q_open_accounts(spark, sf_dir):
    """T5, the REST path: the creation requests as new customers (some with a known or a shared email)."""
    f = fx(spark, sf_dir)
    u = f.ledger.users.select(F.col("id").alias("_uid"), "first_name", "last_name", F.col("email").alias("_known"))
    r = f["create_requests"].join(u, F.col("user_id") == F.col("_uid"), "left")
    fresh = F.concat(F.lit("new"), F.floor(F.col("user_id") / 2).cast("string"), F.lit("@example.com"))
    email = F.when(F.col("request_id") % 3 == 0, F.col("_known")).otherwise(fresh)
    req = r.select("request_id", "first_name", "last_name", email.alias("email"), F.col("initial_balance").alias("initial_deposit"))
    return JB.open_accounts(req, f.ledger, AS_OF).results


def _close_requests(ledger):
    return ledger.accounts.select(F.col("id").alias("request_id"), "account_number",
                                  F.lit(None).cast("string").alias("reason"))


@register("close_accounts", views=("accounts",), oracle="""
SELECT a.id AS request_id, a.account_number, (x.id IS NOT NULL AND x.balance = 0) AS accepted,
  CASE WHEN x.id IS NULL THEN 'account_not_found' WHEN x.balance <> 0 THEN 'non_zero_balance' END AS reason
FROM accounts a LEFT JOIN accounts x ON x.account_number = a.account_number AND x.status = 'active'""")
def q_close_accounts(spark, sf_dir):
    """Every account is asked to close; active zero-balance ones succeed."""
    led = fx(spark, sf_dir).ledger
    return JB.close_accounts(_close_requests(led), led, AS_OF).results


_INTEREST_SQL = """CASE WHEN status = 'active' THEN CAST(CAST(sign(n) * ((abs(n) * 2 + 120000) // 240000)
  AS DECIMAL(38,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(15,2)) ELSE CAST(0 AS DECIMAL(15,2)) END"""
_INTEREST_FROM = """(SELECT *, CAST(balance * 100 AS HUGEINT) * CAST(COALESCE(interest_rate, 0) * 10000 AS HUGEINT) AS n
  FROM accounts)"""


@register("monthly_interest", views=("accounts",), oracle=f"""
SELECT account_number, {_INTEREST_SQL} AS interest FROM {_INTEREST_FROM}""")
def q_monthly_interest(spark, sf_dir):
    """Monthly interest of every account."""
    return JB.monthly_interest(fx(spark, sf_dir).ledger)


_DUE = f"(period = 'daily' AND (reset_at IS NULL OR reset_at <= TIMESTAMP '{AS_OF}'))"


@register("reset_daily_limits", views=("accounts", "account_limits"), oracle=f"""
SELECT id, account_id, limit_type, amount, period,
  CASE WHEN {_DUE} THEN CAST(0 AS DECIMAL(15,2)) ELSE current_usage END AS current_usage,
  CASE WHEN {_DUE} THEN TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY ELSE reset_at END AS reset_at,
  created_at, CASE WHEN {_DUE} THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM account_limits""")
def q_reset_daily_limits(spark, sf_dir):
    """The limits table after the daily reset."""
    return JB.reset_daily_limits(fx(spark, sf_dir).ledger.account_limits, AS_OF)


@register("reset_count", views=("accounts", "account_limits"), oracle=f"""
SELECT COUNT(*) AS reset_count FROM account_limits WHERE {_DUE}""")
def q_reset_count(spark, sf_dir):
    """How many limits the daily reset touches."""
    return JB.reset_count(fx(spark, sf_dir).ledger.account_limits, AS_OF)


@register("expire_sessions", views=("sessions",), oracle=f"""
SELECT id, user_id, token_hash, device_info, ip_address, user_agent, expires_at, created_at, last_activity,
  CASE WHEN is_active AND expires_at < TIMESTAMP '{AS_OF}' THEN false ELSE is_active END AS is_active
FROM sessions""")
def q_expire_sessions(spark, sf_dir):
    """The sessions table after expiry."""
    return JB.expire_sessions(fx(spark, sf_dir).ledger.sessions, AS_OF)


_AUDIT_SQL = f"""
SELECT id AS id, id AS account_id, 'balance_change' AS action, 'account' AS entity_type, id AS entity_id,
  '{{"balance":' || CAST(balance AS VARCHAR) || ',"updated_at":' ||
    COALESCE('"' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000') || '"', 'null') || '}}' AS old_values,
  '{{"balance":' || CAST(new_balance AS VARCHAR) || ',"updated_at":"' || strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%dT%H:%M:%S.000') || '"}}' AS new_values,
  TIMESTAMP '{AS_OF}' AS created_at
FROM (SELECT *, CAST(balance + {_INTEREST_SQL} AS DECIMAL(15,2)) AS new_balance FROM {_INTEREST_FROM})
WHERE new_balance <> balance"""
_AUDIT_COLS = "id, account_id, action, entity_type, entity_id, old_values, new_values, created_at"


def _interest_audit(led):
    return JB.balance_audit(led.accounts, JB.credit_interest(led), AS_OF)


@register("balance_audit", views=("accounts",), oracle=_AUDIT_SQL)
def q_balance_audit(spark, sf_dir):
    """Audit rows for the balances changed by crediting interest."""
    return _interest_audit(fx(spark, sf_dir).ledger).select(*_AUDIT_COLS.split(", "))


@register("audit_trail", views=("accounts",), oracle=_AUDIT_SQL)
def q_audit_trail(spark, sf_dir):
    """Audit rows newest first (all accounts)."""
    return W.audit_trail(_interest_audit(fx(spark, sf_dir).ledger)).select(*_AUDIT_COLS.split(", "))


@register("touch_updated_at", views=("accounts",), oracle=f"""
SELECT id, CAST(balance + {_INTEREST_SQL} AS DECIMAL(15,2)) AS balance,
  CASE WHEN {_INTEREST_SQL} <> 0 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
FROM {_INTEREST_FROM}""")
def q_touch_updated_at(spark, sf_dir):
    """updated_at stamped on the accounts that crediting interest changed."""
    led = fx(spark, sf_dir).ledger
    return JB.touch_updated_at(led.accounts, JB.credit_interest(led), AS_OF).select("id", "balance", "updated_at")


@register("validate_debits", views=("accounts", "transactions"), oracle="""
SELECT t.id AS transaction_id, t.account_id, t.type, t.amount, a.balance, COALESCE(a.overdraft_limit, 0) AS overdraft_limit
FROM transactions t JOIN accounts a ON a.id = t.account_id
WHERE t.type IN ('withdrawal', 'transfer') AND a.balance - t.amount < -COALESCE(a.overdraft_limit, 0)""")
def q_validate_debits(spark, sf_dir):
    """Fixture withdrawal/transfer rows that would break the overdraft floor."""
    led = fx(spark, sf_dir).ledger
    return JB.validate_debits(led.transactions, led.accounts)


_ALERT_TAIL = ", false AS is_read, CAST(NULL AS TIMESTAMP) AS read_at, t.created_at, CAST(NULL AS VARCHAR) AS metadata"
_LARGE_SQL = f"""
SELECT t.id, a.user_id, t.account_id, CAST(NULL AS BIGINT) AS transaction_id, 'large_transaction' AS type, 'info' AS severity,
  'Large Deposit' AS title, 'A deposit of $' || CAST(t.amount AS VARCHAR) || ' was made to account ' || a.account_number AS message
  {_ALERT_TAIL}
FROM ({RUNNING_SQL}) t JOIN accounts a ON a.id = t.account_id WHERE t.type = 'deposit' AND t.amount > 10000"""
_LOW_SQL = f"""
SELECT t.id, a.user_id, t.account_id, CAST(NULL AS BIGINT) AS transaction_id, 'low_balance' AS type, 'warning' AS severity,
  'Low Balance Alert' AS title, 'Your account ' || a.account_number || ' balance is $' || CAST(t.balance_after AS VARCHAR) AS message
  {_ALERT_TAIL}
FROM ({RUNNING_SQL}) t JOIN accounts a ON a.id = t.account_id WHERE t.type = 'withdrawal' AND t.balance_after < 100"""


def _posted_fixture(led):
    return W.running_balance(led.transactions)


@register("large_deposit_alerts", views=("accounts", "transactions"), oracle=_LARGE_SQL)
def q_large_deposit_alerts(spark, sf_dir):
    """Large-deposit rule over the fixture rows posted from zero."""
    led = fx(spark, sf_dir).ledger
    return JB.alert_rules(_posted_fixture(led), led.accounts, "large_deposit")


@register("low_balance_alerts", views=("accounts", "transactions"), oracle=_LOW_SQL)
def q_low_balance_alerts(spark, sf_dir):
    """Low-balance rule over the fixture rows posted from zero."""
    led = fx(spark, sf_dir).ledger
    return JB.alert_rules(_posted_fixture(led), led.accounts, "low_balance")


@register("transfer_received_alerts", views=_POST_VIEWS, recursive=True, oracle=_walked(f"{_REQ_SQL} WHERE op = 'transfer'") + f"""
SELECT tx + 1 AS id, dst_user AS user_id, dst AS account_id, CAST(NULL AS BIGINT) AS transaction_id, {_RECEIVED},
  false AS is_read, CAST(NULL AS TIMESTAMP) AS read_at, requested_at AS created_at, CAST(NULL AS VARCHAR) AS metadata
FROM done WHERE reason IS NULL""")
def q_transfer_received_alerts(spark, sf_dir):
    """Transfer-received rule over the rows the transfer batch posts."""
    f = fx(spark, sf_dir)
    out = T.post(f["post_requests"].where(F.col("op") == "transfer"), f.ledger, AS_OF)
    return JB.alert_rules(out.transactions, f.ledger.accounts, "transfer_received")


@register("unread_alerts", views=("accounts", "transactions"), oracle=f"{_LARGE_SQL} UNION ALL {_LOW_SQL}")
def q_unread_alerts(spark, sf_dir):
    """Unread alerts (those raised by the two rules above), newest first."""
    led = fx(spark, sf_dir).ledger
    posted = _posted_fixture(led)
    alerts = JB.alert_rules(posted, led.accounts, "large_deposit").unionByName(
        JB.alert_rules(posted, led.accounts, "low_balance"))
    return P.unread_alerts(alerts)


_B = "CASE WHEN ok THEN body END"


@register("request_validation", views=("raw_requests",), oracle=f"""
SELECT request_id, reason IS NULL AS valid, reason FROM (
  SELECT request_id, CASE
    WHEN NOT ok THEN 'invalid_json'
    WHEN COALESCE(json_extract_string({_B}, '$.accountNumber'), '') = ''
      OR COALESCE(json_extract_string({_B}, '$.type'), '') = ''
      OR NOT COALESCE(json_exists({_B}, '$.amount'), false) THEN 'missing_fields'
    WHEN NOT regexp_matches(json_extract_string({_B}, '$.accountNumber'), '^KB[0-9]+$') THEN 'invalid_account_number'
    WHEN NOT COALESCE(json_type({_B}, '$.amount') IN ('UBIGINT','BIGINT','DOUBLE','HUGEINT'), false)
      OR TRY_CAST(json_extract_string({_B}, '$.amount') AS DECIMAL(15,2)) <= 0 THEN 'invalid_amount'
    WHEN json_extract_string({_B}, '$.type') NOT IN ('deposit', 'withdrawal') THEN 'invalid_type' END AS reason
  FROM (SELECT request_id, body, COALESCE(json_valid(body), false)
          AND CASE WHEN json_valid(body) THEN json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' ELSE false END AS ok
        FROM raw_requests))""")
def q_request_validation(spark, sf_dir):
    """The API's checks on the raw transaction request bodies."""
    parsed = R.read_requests(fx(spark, sf_dir)["raw_requests"])
    return V.validate_transaction_requests(parsed).select("request_id", "valid", "reason")


# --------------------------------------------------------------------------- data quality
ALL_TABLES = ("users", "accounts", "transactions", "sessions", "account_limits", "transfer_queue", "audit_logs", "alerts")
_HEAD = "SELECT '{t}' AS table_name, '{r}' AS rule, '{c}' AS column_name, "


def _dq_sql_not_null():
    return " UNION ALL ".join(
        _HEAD.format(t=t, r="not_null", c=c) + f"CAST(id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS value, "
        f"CAST(1 AS BIGINT) AS n_rows FROM {t} WHERE {c} IS NULL"
        for t, cols in Q.NOT_NULL.items() for c in cols)


def _dq_sql_unique():
    return " UNION ALL ".join(
        _HEAD.format(t=t, r="unique", c=c) + f"CAST(NULL AS VARCHAR) AS row_key, CAST({c} AS VARCHAR) AS value, "
        f"COUNT(*) AS n_rows FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1"
        for t, c in Q.UNIQUE)


def _row_sql(t, r, c, check):
    return (_HEAD.format(t=t, r=r, c=c) + f"CAST(id AS VARCHAR) AS row_key, CAST({c} AS VARCHAR) AS value, "
            f"CAST(1 AS BIGINT) AS n_rows FROM {t} WHERE NOT COALESCE({check}, true)")


def _dq_sql_domain():
    return " UNION ALL ".join(
        _row_sql(t, "domain", c, f"{c} IN ({', '.join(repr(v) for v in allowed)})") for t, c, allowed in Q.DOMAIN)


def _dq_sql_format():
    return " UNION ALL ".join([
        _row_sql("users", "format", "email", f"regexp_matches(email, '{X.EMAIL_TABLE_RULE}', 'i')"),
        _row_sql("accounts", "format", "account_number",
                 f"regexp_matches(account_number, '{X.ACCOUNT_NUMBER_TABLE_RULE}')"),
    ])


def _dq_sql_range():
    return " UNION ALL ".join(_row_sql(t, "range", c, check) for t, c, check in Q.RANGE)


def _dq_sql_fk():
    return " UNION ALL ".join(
        _HEAD.format(t=t, r="foreign_key", c=c) + f"CAST(id AS VARCHAR) AS row_key, CAST({c} AS VARCHAR) AS value, "
        f"CAST(1 AS BIGINT) AS n_rows FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {p} WHERE id IS NOT NULL)"
        for t, c, p in Q.FOREIGN_KEYS)


for _key, _fn, _sql in [
    ("dq_not_null", Q.dq_not_null, _dq_sql_not_null()),
    ("dq_unique", Q.dq_unique, _dq_sql_unique()),
    ("dq_domain", Q.dq_domain, _dq_sql_domain()),
    ("dq_format", Q.dq_format, _dq_sql_format()),
    ("dq_range", Q.dq_range, _dq_sql_range()),
    ("dq_foreign_key", Q.dq_foreign_key, _dq_sql_fk()),
]:
    def _run(spark, sf_dir, _fn=_fn):
        return _fn(fx(spark, sf_dir).ledger)
    _run.__doc__ = f"Q: {_fn.__doc__}"
    register(_key, views=ALL_TABLES, oracle=_sql)(_run)


@register("dq_domain_dirty", views=ALL_TABLES, oracle=_HEAD.format(t="transactions", r="domain", c="type") + """
  CAST(id AS VARCHAR) AS row_key, upper(type) AS value, CAST(1 AS BIGINT) AS n_rows FROM transactions WHERE amount > 100000
UNION ALL """ + _HEAD.format(t="accounts", r="domain", c="status") + """
  CAST(id AS VARCHAR), 'shut', CAST(1 AS BIGINT) FROM accounts WHERE status = 'closed'""")
def q_dq_domain_dirty(spark, sf_dir):
    """Q3 on rows that fail: the fixture's large transactions with their type in
    capitals, and its closed accounts with an unknown status."""
    led = fx(spark, sf_dir).ledger
    tx = led.transactions.withColumn("type", F.when(F.col("amount") > 100000, F.upper("type")).otherwise(F.col("type")))
    acc = led.accounts.withColumn("status", F.when(F.col("status") == "closed", "shut").otherwise(F.col("status")))
    return Q.dq_domain(led.with_tables(transactions=tx, accounts=acc))


# --------------------------------------------------------------------------- snapshots, streams, metrics
import os  # noqa: E402
import uuid  # noqa: E402

from .. import schemas  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402
from ..sources import constraints as CN  # noqa: E402
from ..sources import history as H  # noqa: E402
from ..sources import ledger as L  # noqa: E402
from ..sources import snapshots as S  # noqa: E402
from ..sources import store as ST  # noqa: E402
from ..streaming import alerts as XA  # noqa: E402
from ..streaming import posting as XP  # noqa: E402
from ..streaming import rates as XR  # noqa: E402

OLD_SNAPSHOT_AT = "2023-11-01 00:00:00"


def scratch(spark) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "ledgerline-scratch", uuid.uuid4().hex)


_TX_ALL = ", ".join(c for c, _, _ in schemas.TABLES["transactions"])


@register("load_ledger", views=("transactions",), oracle=f"SELECT {_TX_ALL} FROM transactions")
def q_load_ledger(spark, sf_dir):
    """Typed read of a written ledger (the fixture exported once, then read
    back with the declared schemas); returns the transactions table."""
    root = scratch(spark)
    S.snapshot_export(fx(spark, sf_dir).ledger, root, AS_OF)
    return L.load_ledger(spark, os.path.join(root, S.snapshot_name(AS_OF))).transactions


@register("snapshot_export", views=ALL_TABLES, oracle=" UNION ALL ".join(
    f"SELECT '{S.snapshot_name(AS_OF)}' AS snapshot, '{t}' AS table_name, COUNT(*) AS row_count, true AS checksum_ok, "
    f"TIMESTAMP '{AS_OF}' AS created_at, 'ledgerline' AS source FROM {t}" for t in schemas.LEDGER_TABLES))
def q_snapshot_export(spark, sf_dir):
    """Export the fixture ledger; the manifest rows, each checksum held against
    that of the table before it was written."""
    led = fx(spark, sf_dir).ledger
    manifest = S.snapshot_export(led, scratch(spark), AS_OF)
    own = None
    for t, df in led.tables().items():
        row = S._checksum(schemas.conform(df, schemas.TABLES[t])).select(F.lit(t).alias("table_name"), F.col("checksum").alias("_own"))
        own = row if own is None else own.unionByName(row)
    return manifest.join(own, "table_name").select(
        "snapshot", "table_name", "row_count", (F.col("checksum") == F.col("_own")).alias("checksum_ok"), "created_at", "source")


@register("snapshot_restore", views=ALL_TABLES, oracle=" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS expected_rows, COUNT(*) AS actual_rows, true AS checksum_ok, true AS ok FROM {t}"
    for t in schemas.LEDGER_TABLES))
def q_snapshot_restore(spark, sf_dir):
    """Restore the exported fixture ledger and verify it against its manifest."""
    root = scratch(spark)
    S.snapshot_export(fx(spark, sf_dir).ledger, root, AS_OF)
    return S.snapshot_restore(spark, root, S.snapshot_name(AS_OF))[1]


@register("snapshot_retention", views=ALL_TABLES, oracle=" UNION ALL ".join(
    f"SELECT '{S.snapshot_name(OLD_SNAPSHOT_AT)}' AS snapshot, TIMESTAMP '{OLD_SNAPSHOT_AT}' AS created_at, "
    f"'{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in schemas.LEDGER_TABLES))
def q_snapshot_retention(spark, sf_dir):
    """Two exports (2023-11-01 and as_of); the one past 30 days is listed."""
    root = scratch(spark)
    led = fx(spark, sf_dir).ledger
    S.snapshot_export(led, root, OLD_SNAPSHOT_AT)
    S.snapshot_export(led, root, AS_OF)
    return S.snapshot_retention(spark, root, AS_OF, keep_days=30)


@register("apply_updates", views=ALL_TABLES + ("post_requests",), recursive=True, oracle=_walked(_REQ_SQL) + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t})" + {
        "transactions": " + (SELECT COUNT(*) FROM legs)", "audit_logs": " + (SELECT COUNT(*) FROM legs)",
        "alerts": " + (SELECT COUNT(*) FROM legs WHERE (op = 'deposit' AND amount > 10000) OR (op = 'withdrawal' AND a < 10000) "
                  "OR (op = 'transfer' AND type = 'deposit'))"}.get(t, "") + " AS row_count"
    for t in schemas.LEDGER_TABLES))
def q_apply_updates(spark, sf_dir):
    """The fixture ledger becomes batch 0 of a store, the fixture requests
    post and append as batch 1; the row counts of the committed ledger."""
    f = fx(spark, sf_dir)
    root = scratch(spark)
    ST.init_store(f.ledger, root, AS_OF)
    ledger = ST.read_store(spark, root)
    ST.apply_updates(root, T.post(f["post_requests"], ledger, AS_OF), AS_OF)
    return L.verify_load(ST.read_store(spark, root))


def _history(spark, sf_dir):
    """The fixture's posted rows as a history of three batches, each with rows of all times (so the later ones are late)."""
    root, posted = scratch(spark), _posted_fixture(fx(spark, sf_dir).ledger)
    for part in range(3):
        H.append(posted.where(F.col("id") % 3 == part), root)
    return root, posted


@register("balance_history", views=("transactions",), oracle=f"""
SELECT account_id, balance_after AS balance FROM (
  SELECT account_id, balance_after, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS rn
  FROM ({RUNNING_SQL}) WHERE created_at <= TIMESTAMP '{POINT_IN_TIME}') WHERE rn = 1""")
def q_balance_history(spark, sf_dir):
    """W4 from balance checkpoints: one checkpoint and one period's rows are read."""
    return H.balance_as_of(spark, _history(spark, sf_dir)[0], POINT_IN_TIME)


@register("balances_at_points", views=("transactions",), oracle=f"""
, posted AS (SELECT account_id, created_at, max_by(balance_after, id) AS balance FROM ({RUNNING_SQL}) GROUP BY 1, 2),
points AS (SELECT account_id, created_at + INTERVAL 20 DAY AS at FROM posted)
SELECT p.account_id, p.at, b.balance FROM points p ASOF LEFT JOIN posted b ON b.account_id = p.account_id AND p.at >= b.created_at""")
def q_balances_at_points(spark, sf_dir):
    """W4 as an as-of join: every account's balance twenty days after each of its postings."""
    root, posted = _history(spark, sf_dir)
    at = F.col("created_at") + F.expr("INTERVAL '20' DAY")
    return H.balances_at(spark, root, posted.select("account_id", at.alias("at")).distinct())


_FAR = 10**12  # beyond every fixture id


@register("commit_violations", views=("transactions", "accounts"), oracle=f"""
, dirty AS (SELECT id, type, CASE WHEN type = 'fee' THEN account_id + {_FAR} ELSE account_id END AS account_id FROM transactions)
SELECT 'transactions' AS table_name, 'unique' AS rule, 'id' AS column_name, CAST(NULL AS VARCHAR) AS row_key,
  CAST(id AS VARCHAR) AS value, CAST(2 AS BIGINT) AS n_rows FROM transactions WHERE type = 'deposit'
UNION ALL SELECT 'transactions', 'unique', 'reference_number', NULL, 'R' || id, 2 FROM transactions WHERE type = 'withdrawal'
UNION ALL SELECT 'transactions', 'foreign_key', 'account_id', CAST(CASE WHEN type = 'deposit' THEN id ELSE id + {2 * _FAR} END AS VARCHAR),
  CAST(account_id AS VARCHAR), 1 FROM dirty WHERE account_id NOT IN (SELECT id FROM accounts)
UNION ALL SELECT 'transactions', 'foreign_key', 'related_transaction_id', CAST(id + {2 * _FAR} AS VARCHAR), CAST(id + {3 * _FAR} AS VARCHAR), 1
  FROM transactions WHERE type = 'refund'""")
def q_commit_violations(spark, sf_dir):
    """Q2 and Q6 before a commit: the ledger is batch 0, its transactions under new ids and references batch 1. In batch 2
    deposits repeat an id of batch 0, withdrawals a reference of batch 1, fees name missing accounts, refunds a missing
    transaction (transfers name one of batch 0)."""
    root, led = scratch(spark), fx(spark, sf_dir).ledger
    ST.init_store(led, root, AS_OF)
    kind, rid = F.col("type"), F.col("id")
    clean = led.transactions.withColumns({"reference_number": F.concat(F.lit("R"), rid), "id": rid + F.lit(_FAR)})
    ST.write_fact(clean, root, "transactions", 1)
    ST.apply_changes(spark, root, {}, AS_OF)
    dirty = led.transactions.withColumns({
        "reference_number": F.concat(F.when(kind == "withdrawal", "R").otherwise("S"), rid),
        "account_id": F.col("account_id") + F.when(kind == "fee", F.lit(_FAR)).otherwise(F.lit(0)),
        "related_transaction_id": F.when(kind == "transfer", rid).when(kind == "refund", rid + F.lit(3 * _FAR)),
        "id": F.when(kind == "deposit", rid).otherwise(rid + F.lit(2 * _FAR)),
    })
    ST.write_fact(dirty, root, "transactions", 2)
    return CN.violations(spark, root, 2)


@register("stream_posting", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + """
SELECT request_id, op, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN """ + _cents("before0 + CASE WHEN op = 'deposit' THEN cents ELSE -cents END") + " END AS new_balance FROM done")
def q_stream_posting(spark, sf_dir):
    """The fixture requests arrive as files and post through the stream
    (foreachBatch -> T4 -> appended store batch); the per-request results."""
    root = scratch(spark)
    f = fx(spark, sf_dir)
    src = os.path.join(root, "requests")
    f["post_requests"].repartitionByRange(4, "requested_at", "request_id").write.parquet(src)
    store_root = os.path.join(root, "store")
    ST.init_store(f.ledger, store_root, AS_OF)
    q = XP.stream_posting(spark, src, store_root, os.path.join(root, "ckpt"), AS_OF)
    q.awaitTermination()
    return XP.posted_results(spark, store_root).select("request_id", "op", "accepted", "reason", "new_balance")


@register("stream_posting_repeated", views=_POST_VIEWS, recursive=True, oracle=_walked(_REQ_SQL) + """
SELECT request_id, op, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN """ + _cents("before0 + CASE WHEN op = 'deposit' THEN cents ELSE -cents END") + """ END AS new_balance FROM done
UNION ALL SELECT request_id, op, false, 'duplicate_request', CAST(NULL AS DECIMAL(15,2)) FROM post_requests WHERE request_id % 11 = 0""")
def q_stream_posting_repeated(spark, sf_dir):
    """X1 with repeats: the first file holds all requests, some twice; after a restart some come again, unchanged (nothing
    happens) or with another amount (one reject row each, however often they are sent)."""
    root = scratch(spark)
    f = fx(spark, sf_dir)
    src, store_root = os.path.join(root, "requests"), os.path.join(root, "store")
    requests = f["post_requests"]
    ST.init_store(f.ledger, store_root, AS_OF)
    for part, rows in enumerate((requests.unionByName(requests.where("request_id % 7 = 0")), _repeated(requests), _repeated(requests))):
        rows.write.parquet(os.path.join(src, f"part={part}"))
        XP.stream_posting(spark, os.path.join(src, "*"), store_root, os.path.join(root, "ckpt"), AS_OF).awaitTermination()
    return XP.posted_results(spark, store_root).select("request_id", "op", "accepted", "reason", "new_balance")


_SENT_SQL = """SELECT *, CASE WHEN request_id % 13 = 0 THEN 'invalid_json' WHEN account_number IS NULL OR amount IS NULL
      OR (op = 'transfer' AND to_account IS NULL) THEN 'missing_fields' WHEN amount <= 0 THEN 'invalid_amount'
    WHEN account_number = to_account THEN 'same_account' END AS broken FROM post_requests"""


@register("stream_bodies", views=_POST_VIEWS, recursive=True, oracle=_walked(f"{_REQ_SQL[:_REQ_SQL.rindex('FROM')]} FROM ({_SENT_SQL}) WHERE broken IS NULL") + f"""
SELECT request_id, 'result' AS sink, reason, CASE WHEN reason IS NULL THEN
  {_cents("before0 + CASE WHEN op = 'deposit' THEN cents ELSE -cents END")} END AS new_balance FROM done
UNION ALL SELECT request_id, 'reject', broken, CAST(NULL AS DECIMAL(15,2)) FROM ({_SENT_SQL}) WHERE broken IS NOT NULL""")
def q_stream_bodies(spark, sf_dir):
    """S2 as a stream into X1: the fixture requests arrive as JSON envelopes, some bodies cut off; after a restart some
    lines come again, broken ones too. Results and dead letters, each once."""
    root = scratch(spark)
    f = fx(spark, sf_dir)
    src, store_root = os.path.join(root, "lines"), os.path.join(root, "store")
    number = F.get_json_object("value", "$.requestId").cast("bigint")
    # the body is the envelope's last member: it loses its closing brace
    lines = R.envelopes(f["post_requests"]).withColumn(
        "value", F.when(number % 13 == 0, F.regexp_replace("value", r'\}"\}$', '"}')).otherwise(F.col("value")))
    ST.init_store(f.ledger, store_root, AS_OF)
    again = number % 7 == 0
    for part, rows in enumerate((lines, lines.where(again))):
        rows.write.text(os.path.join(src, f"part={part}"))
        XP.stream_bodies(spark, os.path.join(src, "*"), store_root, os.path.join(root, "ckpt"), AS_OF).awaitTermination()
    results = XP.posted_results(spark, store_root).select("request_id", F.lit("result").alias("sink"), "reason", "new_balance")
    return results.unionByName(XP.rejected_lines(spark, store_root).select(
        "request_id", F.lit("reject").alias("sink"), "reason", F.lit(None).cast(schemas.MONEY).alias("new_balance")))


_RATE_SQL = """
SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start,
  time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end, ip, COUNT(*) AS requests
FROM request_log GROUP BY 1, 2, 3 HAVING COUNT(*) > {limit}"""


@register("request_rate_breaches", views=("request_log",), oracle=_RATE_SQL.format(limit=2))
def q_request_rate_breaches(spark, sf_dir):
    """Clients with more than 2 requests in a 15-minute window (the
    fixture's busiest client makes 3; the API default is 100)."""
    return XR.request_rate_breaches(fx(spark, sf_dir)["request_log"], max_requests=2)


@register("stream_rate_breaches", views=("request_log",), oracle=_RATE_SQL.format(limit=1))
def q_stream_rate_breaches(spark, sf_dir):
    """X2 on a stream: the request log arrives as files; clients with more than 1
    request in a 15-minute window."""
    root = scratch(spark)
    log = fx(spark, sf_dir)["request_log"]
    src = os.path.join(root, "log")
    log.repartitionByRange(3, "ts").write.parquet(src)
    q = XR.stream_rate_breaches(spark, src, log.schema, os.path.join(root, "breaches"), os.path.join(root, "ckpt"),
                                max_requests=1)
    q.awaitTermination()
    return XR.written_breaches(spark, os.path.join(root, "breaches"))


@register("stream_rate_decisions", views=("request_log",), oracle="""
SELECT ts, ip, CASE WHEN rn <= 1 THEN rn END AS position FROM (
  SELECT ts, ip, CAST(row_number() OVER (PARTITION BY ip, time_bucket(INTERVAL '15 minutes', ts) ORDER BY ts) AS INTEGER) AS rn FROM request_log)""")
def q_stream_rate_decisions(spark, sf_dir):
    """X2 per request: one request per client and window passes; the log arrives in two parts, the stream restarts between."""
    root = scratch(spark)
    log = fx(spark, sf_dir)["request_log"]
    src, sink = os.path.join(root, "log"), os.path.join(root, "decisions")
    middle = log.agg(F.expr("approx_percentile(unix_micros(CAST(ts AS TIMESTAMP_LTZ)), 0.5)")).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp_ltz")) <= middle
    for part, rows in enumerate((log.where(early), log.where(~early))):
        rows.write.parquet(os.path.join(src, f"part={part}"))
        XR.stream_rate_decisions(spark, os.path.join(src, "*"), log.schema, sink, os.path.join(root, "ckpt"), max_requests=1).awaitTermination()
    return spark.read.parquet(sink).select("ts", "ip", "position")


@register("stream_alerts", views=("accounts", "transactions"), oracle=f"{_LARGE_SQL} UNION ALL {_LOW_SQL}")
def q_stream_alerts(spark, sf_dir):
    """Alert rules on a stream of the fixture rows posted from zero."""
    root = scratch(spark)
    led = fx(spark, sf_dir).ledger
    posted = schemas.conform(_posted_fixture(led), schemas.TABLES["transactions"])
    src = os.path.join(root, "posted")
    posted.write.parquet(src)
    q = XA.run_stream_alerts(spark, src, led.accounts, os.path.join(root, "alerts"), os.path.join(root, "ckpt"))
    q.awaitTermination()
    return spark.read.schema(schemas.table_schema("alerts")).parquet(os.path.join(root, "alerts"))


@register("query_duration_histogram", views=("request_log",), oracle=f"""
SELECT g.query_type, b.le,
  (SELECT COUNT(*) FROM request_log r WHERE r.status_code < 400 AND r.method = g.method AND r.route = g.route
     AND (b.bound IS NULL OR r.duration_s <= b.bound)) AS bucket_count,
  g.duration_sum, g.duration_count
FROM (SELECT method, route, CASE WHEN method = 'POST' AND route = '/api/accounts' THEN 'account_creation'
        WHEN method = 'GET' AND route = '/api/accounts/:accountNumber' THEN 'account_query'
        WHEN method = 'POST' AND route = '/api/transactions' THEN 'transaction'
        WHEN method = 'GET' AND route = '/api/accounts/:accountNumber/transactions' THEN 'transaction_history'
        WHEN method = 'POST' AND route = '/api/transfers' THEN 'transfer' END AS query_type,
        COUNT(*) AS duration_count, CAST(SUM(duration_s) AS DECIMAL(20,4)) AS duration_sum
      FROM request_log WHERE status_code < 400 GROUP BY 1, 2, 3) g,
     (VALUES {", ".join(f"({i}, '{b}', CAST('{b}' AS DECIMAL(10,4)))" for i, b in enumerate(M.DEFAULT_BUCKETS))},
             ({len(M.DEFAULT_BUCKETS)}, '+Inf', NULL)) AS b(pos, le, bound)""")
def q_query_duration_histogram(spark, sf_dir):
    """A7 (second form): successful request durations by database query type."""
    return M.duration_histogram(fx(spark, sf_dir)["request_log"], by="query_type")


@register("process_transfer_queue", views=("accounts", "transactions", "account_limits", "transfer_queue"), recursive=True, oracle=_walked(f"""
  SELECT q.id AS request_id, q.scheduled_at AS requested_at, f.account_number, 'transfer' AS op, t.account_number AS to_account, q.amount
  FROM transfer_queue q LEFT JOIN accounts f ON f.id = q.from_account_id LEFT JOIN accounts t ON t.id = q.to_account_id
  WHERE q.status = 'pending' AND q.scheduled_at <= TIMESTAMP '{AS_OF}'""") + f"""
SELECT q.id, q.from_account_id, q.to_account_id, q.amount, q.scheduled_at,
  CASE WHEN d.request_id IS NULL THEN q.status WHEN d.reason IS NULL THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN d.request_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE q.processed_at END AS processed_at,
  CASE WHEN d.request_id IS NOT NULL AND d.reason IS NULL THEN d.tx ELSE q.transaction_id END AS transaction_id,
  CASE WHEN d.reason IS NOT NULL THEN d.reason ELSE q.error_message END AS error_message,
  q.retry_count + CASE WHEN d.reason IS NOT NULL THEN 1 ELSE 0 END AS retry_count
FROM transfer_queue q LEFT JOIN done d ON d.request_id = q.id""")
def q_process_transfer_queue(spark, sf_dir):
    """P10 -> T3: the due queue transfers posted in order; the new queue."""
    return T.process_transfer_queue(fx(spark, sf_dir).ledger, AS_OF)[0].select(
        "id", "from_account_id", "to_account_id", "amount", "scheduled_at", "status", "processed_at", "transaction_id",
        "error_message", "retry_count")


_API_STATIC = """CASE WHEN r.account_number IS NULL OR r.amount IS NULL THEN 'missing_fields'
         WHEN NOT regexp_matches(r.account_number, '^KB[0-9]+$') THEN 'invalid_account_number'
         WHEN r.amount <= 0 THEN 'invalid_amount' WHEN a.id IS NULL THEN 'account_not_found' END"""


@register("post_deposits_api", views=("accounts", "transactions", "post_requests"), oracle=f""",
chk AS (
  SELECT r.request_id, r.requested_at, r.amount, a.id AS acct, a.balance, {_API_STATIC} AS reason
  FROM post_requests r LEFT JOIN accounts a ON a.account_number = r.account_number
  WHERE r.op = 'deposit')
SELECT request_id, 'deposit' AS op, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN CAST(balance + SUM(CASE WHEN reason IS NULL THEN amount ELSE 0 END)
    OVER (PARTITION BY acct ORDER BY requested_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS DECIMAL(15,2)) END AS new_balance,
  CASE WHEN reason IS NULL THEN {_TX_BASE} + 2 * request_id END AS transaction_id
FROM chk""")
def q_post_deposits_api(spark, sf_dir):
    """T1 under the REST endpoint's rules: any account status (D6), API
    formats (D10), no alerts."""
    f = fx(spark, sf_dir)
    return T.post(f["post_requests"].where(F.col("op") == "deposit"), f.ledger, AS_OF, rules="api").results


@register("post_withdrawals_api", views=("accounts", "transactions", "post_requests"), recursive=True, oracle=f""",
chk AS (
  SELECT r.request_id, r.requested_at, r.amount, a.id AS acct, a.balance, COALESCE(a.overdraft_limit, 0) AS od,
    {_API_STATIC} AS sreason
  FROM post_requests r LEFT JOIN accounts a ON a.account_number = r.account_number
  WHERE r.op = 'withdrawal'),
v AS (SELECT *, row_number() OVER (PARTITION BY acct ORDER BY requested_at, request_id) AS pos
      FROM chk WHERE sreason IS NULL),
walk(acct, pos, bal, request_id, reason) AS (
  SELECT DISTINCT acct, CAST(0 AS BIGINT), CAST(balance AS DECIMAL(38,2)), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM v
  UNION ALL
  SELECT v.acct, v.pos,
    CASE WHEN w.bal < v.amount AND w.bal - v.amount < -v.od THEN w.bal ELSE w.bal - v.amount END,
    v.request_id,
    CASE WHEN w.bal < v.amount AND w.bal - v.amount < -v.od THEN 'insufficient_funds' END
  FROM walk w JOIN v ON v.acct = w.acct AND v.pos = w.pos + 1)
SELECT c.request_id, 'withdrawal' AS op, COALESCE(c.sreason, w.reason) IS NULL AS accepted,
  COALESCE(c.sreason, w.reason) AS reason,
  CASE WHEN COALESCE(c.sreason, w.reason) IS NULL THEN CAST(w.bal AS DECIMAL(15,2)) END AS new_balance,
  CASE WHEN COALESCE(c.sreason, w.reason) IS NULL THEN {_TX_BASE} + 2 * c.request_id END AS transaction_id
FROM chk c LEFT JOIN walk w ON w.request_id = c.request_id""")
def q_post_withdrawals_api(spark, sf_dir):
    """T2 under the REST endpoint's rules: any status, the API's funds test
    (``balance < amount AND balance - amount < -overdraft`` rejects), no limits."""
    f = fx(spark, sf_dir)
    return T.post(f["post_requests"].where(F.col("op") == "withdrawal"), f.ledger, AS_OF, rules="api").results


def _transfer_bodies(f):
    """Transfer request bodies as the API receives them (JSON text)."""
    r = f["post_requests"].where(F.col("op") == "transfer")
    return r.select("request_id", F.to_json(F.struct(
        F.col("account_number").alias("fromAccount"), F.col("to_account").alias("toAccount"),
        F.col("amount").alias("amount"), F.col("description").alias("description"))).alias("body"))


def _account_bodies(f):
    """Account-creation bodies (names and email of the requesting user, the
    opening amount as initialDeposit)."""
    u = f.ledger.users.select(F.col("id").alias("_uid"), "first_name", "last_name", "email")
    r = f["create_requests"].join(u, F.col("user_id") == F.col("_uid"), "left")
    return r.select("request_id", F.to_json(F.struct(
        F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"), F.col("email").alias("email"),
        F.col("initial_balance").alias("initialDeposit"))).alias("body"))


@register("transfer_request_validation", views=("post_requests",), oracle="""
SELECT request_id, reason IS NULL AS valid, reason FROM (
  SELECT request_id, CASE
    WHEN COALESCE(account_number, '') = '' OR COALESCE(to_account, '') = '' OR amount IS NULL THEN 'missing_fields'
    WHEN NOT regexp_matches(account_number, '^KB[0-9]+$') OR NOT regexp_matches(to_account, '^KB[0-9]+$')
      THEN 'invalid_account_number'
    WHEN amount <= 0 THEN 'invalid_amount'
    WHEN account_number = to_account THEN 'same_account' END AS reason
  FROM post_requests WHERE op = 'transfer')""")
def q_transfer_request_validation(spark, sf_dir):
    """The API's transfer checks on transfer request bodies."""
    bodies = _transfer_bodies(fx(spark, sf_dir))
    parsed = R.read_requests(bodies, schema=R.TRANSFER_BODY)
    return V.validate_transfer_requests(parsed).select("request_id", "valid", "reason")


@register("account_request_validation", views=("users", "create_requests"), oracle=f"""
SELECT request_id, reason IS NULL AS valid, reason FROM (
  SELECT r.request_id, CASE
    WHEN COALESCE(u.first_name, '') = '' OR COALESCE(u.last_name, '') = '' OR COALESCE(u.email, '') = ''
      THEN 'missing_fields'
    WHEN NOT regexp_matches(u.email, '{X.EMAIL_API_RULE}') THEN 'invalid_email'
    WHEN r.initial_balance < 0 THEN 'invalid_initial_deposit' END AS reason
  FROM create_requests r LEFT JOIN users u ON u.id = r.user_id)""")
def q_account_request_validation(spark, sf_dir):
    """The API's account-creation checks on creation request bodies."""
    bodies = _account_bodies(fx(spark, sf_dir))
    parsed = R.read_requests(bodies, schema=R.ACCOUNT_BODY)
    return V.validate_account_requests(parsed).select("request_id", "valid", "reason")


@register("quality_report", views=ALL_TABLES, oracle=" UNION ALL ".join([
    _dq_sql_not_null(), _dq_sql_unique(), _dq_sql_domain(), _dq_sql_format(), _dq_sql_range(), _dq_sql_fk()]))
def q_quality_report(spark, sf_dir):
    """Q1-Q6 in one violations report (table_name, rule, column_name, row_key, value, n_rows)."""
    return Q.quality_report(fx(spark, sf_dir).ledger)
