"""Registered read-side queries: sources, filters, joins, aggregates, windows,
request metrics (inventory sections 2.1-2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import reads as P
from ..operators import windows as W
from ..sources import ledger as L
from ..sources import requests as R
from .catalog import (AS_OF, HISTORY_AS_OF, PAGE_ACCOUNT, PAGE_LIMIT, PAGE_OFFSET, POINT_IN_TIME, SCOPE_USER,
                      SIGNED_SQL, exact_avg_sql, fx, money_text_sql, register)

TX_COLS = "id, account_id, type, amount, status, created_at"


# --------------------------------------------------------------------------- sources
@register("verify_load", views=("users", "accounts", "transactions", "sessions", "account_limits",
                                "transfer_queue", "audit_logs", "alerts"), oracle="""
SELECT 'users' AS table_name, COUNT(*) AS row_count FROM users UNION ALL
SELECT 'accounts', COUNT(*) FROM accounts UNION ALL
SELECT 'transactions', COUNT(*) FROM transactions UNION ALL
SELECT 'audit_logs', COUNT(*) FROM audit_logs g
  WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.status = 'closed' AND a.id = g.account_id) UNION ALL
SELECT 'sessions', COUNT(*) FROM sessions UNION ALL
SELECT 'alerts', COUNT(*) FROM alerts UNION ALL
SELECT 'account_limits', COUNT(*) FROM account_limits UNION ALL
SELECT 'transfer_queue', COUNT(*) FROM transfer_queue""")
def q_verify_load(spark, sf_dir):
    return L.verify_load(fx(spark, sf_dir).ledger)


@register("load_seeds", views=("users", "accounts"), oracle="""
SELECT * FROM accounts UNION ALL
SELECT (SELECT MAX(id) FROM accounts) + s.pos, (SELECT MAX(id) FROM users) + dense_rank() OVER (ORDER BY s.email),
  s.account_number, s.account_type, CAST(s.balance AS DECIMAL(15,2)), 'USD', 'active', CAST(0 AS DECIMAL(15,2)),
  CAST(0 AS DECIMAL(5,4)), TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-15 00:00:00', NULL, NULL
FROM (VALUES (1,'john.doe@example.com','KB2025010100001','checking','5000.00'),
  (2,'john.doe@example.com','KB2025010100002','savings','15000.00'),
  (3,'jane.smith@example.com','KB2025010200001','checking','3500.00'),
  (4,'jane.smith@example.com','KB2025010200002','savings','25000.00'),
  (5,'bob.johnson@example.com','KB2025010300001','business','50000.00')) AS s(pos, email, account_number, account_type, balance)""")
def q_load_seeds(spark, sf_dir):
    return L.load_seeds(fx(spark, sf_dir).ledger, AS_OF).accounts


@register("read_requests", views=("raw_requests",), oracle="""
SELECT request_id, ok AS json_ok,
  json_extract_string(b, '$.accountNumber') AS accountNumber,
  json_extract_string(b, '$.type') AS type,
  COALESCE(json_exists(b, '$.amount'), false) AS amount_present,
  COALESCE(json_type(b, '$.amount') IN ('UBIGINT','BIGINT','DOUBLE','HUGEINT'), false) AS amount_is_number,
  CASE WHEN json_type(b, '$.amount') IN ('UBIGINT','BIGINT','DOUBLE','HUGEINT')
       THEN TRY_CAST(json_extract_string(b, '$.amount') AS DECIMAL(15,2)) END AS amount_value,
  json_extract_string(b, '$.description') AS description
FROM (SELECT request_id, ok, CASE WHEN ok THEN body END AS b FROM (
  SELECT request_id, body, COALESCE(json_valid(body), false)
    AND CASE WHEN json_valid(body) THEN json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' ELSE false END AS ok
  FROM raw_requests))""")
def q_read_requests(spark, sf_dir):
    return R.read_requests(fx(spark, sf_dir)["raw_requests"])


@register("read_request_log", views=("request_log",), oracle="SELECT ts, method, route, status_code, duration_s, ip FROM request_log")
def q_read_request_log(spark, sf_dir):
    lines = R.request_log_lines(fx(spark, sf_dir)["request_log"])
    return R.read_request_log(lines=lines)


# --------------------------------------------------------------------------- filters / projections
@register("account_details", views=("accounts", "users"), oracle="""
SELECT a.id, a.account_number, a.balance, a.status, a.created_at, u.first_name, u.last_name, u.email
FROM accounts a JOIN users u ON a.user_id = u.id""")
def q_account_details(spark, sf_dir):
    return P.account_details(fx(spark, sf_dir).ledger)


@register("active_balance", views=("accounts", "post_requests"), oracle="""
SELECT r.account_number, a.balance, CASE WHEN a.balance IS NULL THEN 'account_not_found' END AS error
FROM (SELECT DISTINCT account_number FROM post_requests) r
LEFT JOIN accounts a ON a.account_number = r.account_number AND a.status = 'active'""")
def q_active_balance(spark, sf_dir):
    f = fx(spark, sf_dir)
    return P.active_balance(f.ledger, f["post_requests"].select("account_number"))


@register("history_by_type", views=("transactions",), oracle=f"SELECT {TX_COLS} FROM transactions WHERE type = 'deposit'")
def q_history_by_type(spark, sf_dir):
    return P.history_by_type(fx(spark, sf_dir).ledger.transactions, "deposit").select(*TX_COLS.split(", "))


@register("statement_lines", views=("transactions",), oracle=f"""
SELECT id AS transaction_id, upper(substr(type, 1, 1)) || substr(type, 2) AS type_label,
  COALESCE(NULLIF(description, ''), 'No description') AS description_text,
  CASE WHEN type = 'deposit' THEN '+' ELSE '-' END || {money_text_sql('amount')} AS amount_text
FROM transactions""")
def q_statement_lines(spark, sf_dir):
    return P.statement_lines(fx(spark, sf_dir).ledger.transactions)


_MS = f"((epoch_us(TIMESTAMP '{HISTORY_AS_OF}') - epoch_us(date_trunc('millisecond', created_at))) // 1000)"


@register("relative_date", views=("transactions",), oracle=f"""
SELECT transaction_id, created_at,
  CASE WHEN mins < 1 THEN 'Just now'
       WHEN mins < 60 THEN CAST(mins AS VARCHAR) || ' min ago'
       WHEN hours < 24 THEN CAST(hours AS VARCHAR) || ' hours ago'
       WHEN days < 7 THEN CAST(days AS VARCHAR) || ' days ago'
       WHEN year(created_at) <> year(TIMESTAMP '{HISTORY_AS_OF}') THEN strftime(created_at, '%b %-d, %Y')
       ELSE strftime(created_at, '%b %-d') END AS age_label
FROM (SELECT id AS transaction_id, created_at,
  CAST(floor({_MS} / 60000.0) AS BIGINT) AS mins, CAST(floor({_MS} / 3600000.0) AS BIGINT) AS hours,
  CAST(floor({_MS} / 86400000.0) AS BIGINT) AS days FROM transactions)""")
def q_relative_date(spark, sf_dir):
    return P.relative_dates(fx(spark, sf_dir).ledger.transactions, HISTORY_AS_OF)


@register("format_currency", views=("accounts",), oracle=f"""
SELECT account_number, balance, {money_text_sql('balance')} AS balance_text FROM accounts""")
def q_format_currency(spark, sf_dir):
    return P.currency_text(fx(spark, sf_dir).ledger.accounts)


@register("live_users", views=("users",), oracle="SELECT * FROM users WHERE deleted_at IS NULL")
def q_live_users(spark, sf_dir):
    return P.live_users(fx(spark, sf_dir).ledger.users)


@register("user_scope", views=("accounts", "transactions"), oracle=f"""
SELECT * FROM transactions WHERE account_id IN (SELECT id FROM accounts WHERE user_id = {SCOPE_USER})""")
def q_user_scope(spark, sf_dir):
    return P.user_scope(fx(spark, sf_dir).ledger, SCOPE_USER)


@register("due_transfers", views=("transfer_queue",), oracle=f"""
SELECT * FROM transfer_queue WHERE status = 'pending' AND scheduled_at <= TIMESTAMP '{AS_OF}'""")
def q_due_transfers(spark, sf_dir):
    return P.due_transfers(fx(spark, sf_dir).ledger.transfer_queue, AS_OF)


@register("active_sessions", views=("sessions",), oracle=f"""
SELECT * FROM sessions WHERE is_active AND expires_at > TIMESTAMP '{AS_OF}'""")
def q_active_sessions(spark, sf_dir):
    return P.active_sessions(fx(spark, sf_dir).ledger.sessions, AS_OF)


# --------------------------------------------------------------------------- joins
@register("accounts_with_users", views=("accounts", "users"), oracle="""
SELECT a.user_id, a.id AS account_id, a.account_number, u.first_name, u.last_name, u.email
FROM accounts a JOIN users u ON a.user_id = u.id""")
def q_accounts_with_users(spark, sf_dir):
    return J.accounts_with_users(fx(spark, sf_dir).ledger)


@register("accounts_left_tx", views=("accounts", "transactions"), oracle="""
SELECT a.id AS account_id, a.account_number, t.id AS transaction_id, t.type, t.amount
FROM accounts a LEFT JOIN transactions t ON a.id = t.account_id""")
def q_accounts_left_tx(spark, sf_dir):
    return J.accounts_left_tx(fx(spark, sf_dir).ledger)


@register("tx_for_account", views=("accounts", "transactions"), oracle="""
SELECT t.id AS transaction_id, t.account_id, t.type, t.amount, t.status, t.created_at, a.account_number
FROM transactions t JOIN accounts a ON t.account_id = a.id""")
def q_tx_for_account(spark, sf_dir):
    return J.tx_for_account(fx(spark, sf_dir).ledger)


@register("left_join_on_status", views=("accounts", "transactions"), oracle="""
SELECT a.id AS account_id, a.account_number, t.id AS transaction_id, t.amount
FROM accounts a LEFT JOIN transactions t ON a.id = t.account_id AND t.status = 'completed'""")
def q_left_join_on_status(spark, sf_dir):
    return J.left_join_on_status(fx(spark, sf_dir).ledger)


@register("orphan_accounts", views=("accounts", "users"), oracle="""
SELECT id AS account_id, user_id, account_number FROM accounts WHERE user_id NOT IN (SELECT id FROM users)""")
def q_orphan_accounts(spark, sf_dir):
    return J.orphan_accounts(fx(spark, sf_dir).ledger)


@register("user_exists", views=("users", "create_requests"), oracle="""
SELECT r.request_id, r.user_id, r.account_type, r.initial_balance,
  EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id) AS user_exists
FROM create_requests r""")
def q_user_exists(spark, sf_dir):
    f = fx(spark, sf_dir)
    return J.user_exists(f["create_requests"], f.ledger.users)


@register("transfer_pair_lookup", views=("accounts", "post_requests"), oracle="""
SELECT r.request_id, fa.id AS from_account_id, ta.id AS to_account_id, fa.balance AS from_balance,
  ta.balance AS to_balance,
  CAST((fa.id IS NOT NULL)::INTEGER + (ta.id IS NOT NULL)::INTEGER AS INTEGER) AS accounts_found,
  (fa.id IS NOT NULL AND ta.id IS NOT NULL) AS pair_found
FROM post_requests r
LEFT JOIN accounts fa ON fa.account_number = r.account_number AND fa.status = 'active'
LEFT JOIN accounts ta ON ta.account_number = r.to_account AND ta.status = 'active'
WHERE r.op = 'transfer'""")
def q_transfer_pair_lookup(spark, sf_dir):
    f = fx(spark, sf_dir)
    return J.transfer_pair_lookup(f.ledger, f["post_requests"].where(F.col("op") == "transfer"))


@register("limit_lookup", views=("accounts", "account_limits"), oracle=f"""
SELECT a.id AS account_id, l.id AS limit_id, l.amount AS limit_amount, l.current_usage
FROM accounts a LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY id) AS rn FROM account_limits
  WHERE limit_type = 'daily_withdrawal' AND (reset_at IS NULL OR reset_at > TIMESTAMP '{AS_OF}')
) l ON l.account_id = a.id AND l.rn = 1""")
def q_limit_lookup(spark, sf_dir):
    led = fx(spark, sf_dir).ledger
    return J.limit_lookup(led.accounts, led.account_limits, "daily_withdrawal", AS_OF)


@register("default_limits", views=("accounts",), oracle="""
SELECT a.id AS account_id, l.k, l.limit_type, CAST(l.amount AS DECIMAL(15,2)) AS amount, l.period
FROM accounts a, (VALUES (0, 'daily_withdrawal', '1000.00', 'daily'), (1, 'daily_transfer', '5000.00', 'daily'),
  (2, 'single_transaction', '2000.00', 'transaction')) AS l(k, limit_type, amount, period)""")
def q_default_limits(spark, sf_dir):
    return J.default_limits(fx(spark, sf_dir).ledger.accounts)


@register("purge_accounts", views=("users", "accounts", "transactions", "sessions", "account_limits",
                                   "transfer_queue", "audit_logs", "alerts"), oracle="""
SELECT 'users' AS table_name, COUNT(*) AS row_count FROM users UNION ALL
SELECT 'accounts', COUNT(*) FROM accounts WHERE status <> 'closed' UNION ALL
SELECT 'transactions', COUNT(*) FROM transactions t
  WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.status = 'closed' AND a.id = t.account_id) UNION ALL
SELECT 'audit_logs', COUNT(*) FROM audit_logs g
  WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.status = 'closed' AND a.id = g.account_id) UNION ALL
SELECT 'sessions', COUNT(*) FROM sessions UNION ALL
SELECT 'alerts', COUNT(*) FROM alerts UNION ALL
SELECT 'account_limits', COUNT(*) FROM account_limits l
  WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.status = 'closed' AND a.id = l.account_id) UNION ALL
SELECT 'transfer_queue', COUNT(*) FROM transfer_queue q
  WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.status = 'closed' AND a.id IN (q.from_account_id, q.to_account_id))""")
def q_purge_accounts(spark, sf_dir):
    led = fx(spark, sf_dir).ledger
    closed = led.accounts.where(F.col("status") == "closed").select("id")
    return L.verify_load(J.purge_accounts(led, closed))


@register("purge_transactions", views=("accounts", "transactions"), oracle="""
SELECT t.id, t.account_id, t.type, t.amount,
  CASE WHEN t.related_account_id IN (SELECT id FROM accounts WHERE status = 'closed') THEN NULL ELSE t.related_account_id END AS related_account_id
FROM transactions t WHERE t.account_id IS NULL OR t.account_id NOT IN (SELECT id FROM accounts WHERE status = 'closed')""")
def q_purge_transactions(spark, sf_dir):
    """The transaction rows that are left when the closed accounts are purged."""
    led = fx(spark, sf_dir).ledger
    closed = led.accounts.where(F.col("status") == "closed").select("id")
    return J.purge_accounts(led, closed).transactions.select("id", "account_id", "type", "amount", "related_account_id")


# --------------------------------------------------------------------------- aggregates
@register("account_summaries", views=("accounts", "users", "transactions"), oracle="""
SELECT a.id AS account_id, a.account_number, a.account_type, a.balance, a.currency, a.status,
  a.created_at AS account_created_at, u.id AS user_id, u.first_name, u.last_name, u.email, u.phone,
  COALESCE(s.n_all, 0) AS total_transactions, COALESCE(s.n_dep, 0) AS total_deposits,
  COALESCE(s.n_wd, 0) AS total_withdrawals,
  CAST(COALESCE(s.sum_dep, 0) AS DECIMAL(25,2)) AS total_deposited,
  CAST(COALESCE(s.sum_wd, 0) AS DECIMAL(25,2)) AS total_withdrawn,
  s.last_at AS last_transaction_at
FROM accounts a
JOIN users u ON u.id = a.user_id AND u.deleted_at IS NULL
LEFT JOIN (
  SELECT account_id,
    COUNT(DISTINCT id) AS n_all,
    COUNT(DISTINCT CASE WHEN type = 'deposit' AND status = 'completed' THEN id END) AS n_dep,
    COUNT(DISTINCT CASE WHEN type = 'withdrawal' AND status = 'completed' THEN id END) AS n_wd,
    SUM(CASE WHEN type = 'deposit' AND status = 'completed' THEN amount END) AS sum_dep,
    SUM(CASE WHEN type = 'withdrawal' AND status = 'completed' THEN amount END) AS sum_wd,
    MAX(created_at) AS last_at
  FROM transactions GROUP BY account_id) s ON s.account_id = a.id""")
def q_account_summaries(spark, sf_dir):
    return A.account_summaries(fx(spark, sf_dir).ledger)


@register("daily_transaction_summary", views=("transactions",), oracle=f"""
SELECT CAST(created_at AS DATE) AS transaction_date, account_id, type, COUNT(*) AS transaction_count,
  CAST(SUM(amount) AS DECIMAL(25,2)) AS total_amount, {exact_avg_sql('SUM(amount)', 'COUNT(*)')} AS avg_amount,
  MIN(amount) AS min_amount, MAX(amount) AS max_amount
FROM transactions WHERE status = 'completed' GROUP BY 1, 2, 3""")
def q_daily_transaction_summary(spark, sf_dir):
    return A.daily_transaction_summary(fx(spark, sf_dir).ledger.transactions)


@register("account_summary_report", views=("accounts", "transactions"), oracle="""
SELECT a.account_number, a.account_type, a.balance,
  CAST(COALESCE(s.dep, 0) AS DECIMAL(15,2)) AS total_deposits,
  CAST(COALESCE(s.wd, 0) AS DECIMAL(15,2)) AS total_withdrawals,
  COALESCE(s.n_done, 0) AS transaction_count, s.last_at AS last_transaction
FROM accounts a LEFT JOIN (
  SELECT account_id,
    SUM(CASE WHEN status = 'completed' AND type = 'deposit' THEN amount END) AS dep,
    SUM(CASE WHEN status = 'completed' AND type = 'withdrawal' THEN amount END) AS wd,
    COUNT(CASE WHEN status = 'completed' THEN id END) AS n_done,
    MAX(created_at) AS last_at
  FROM transactions GROUP BY account_id) s ON s.account_id = a.id""")
def q_account_summary_report(spark, sf_dir):
    return A.account_summary_report(fx(spark, sf_dir).ledger)


@register("balance_reconciliation", views=("accounts", "transactions"), oracle=f"""
SELECT a.account_number, a.balance AS current_balance,
  CAST(COALESCE(s.total, 0) AS DECIMAL(25,2)) AS calculated_balance
FROM accounts a LEFT JOIN (
  SELECT account_id, SUM({SIGNED_SQL}) AS total FROM transactions WHERE status = 'completed' GROUP BY account_id
) s ON s.account_id = a.id
WHERE a.balance <> COALESCE(s.total, 0)""")
def q_balance_reconciliation(spark, sf_dir):
    return A.balance_reconciliation(fx(spark, sf_dir).ledger)


@register("last_transaction", views=("accounts", "transactions"), oracle="""
SELECT a.id AS account_id, MAX(COALESCE(t.completed_at, t.created_at)) AS last_transaction_at
FROM accounts a LEFT JOIN transactions t ON a.id = t.account_id AND t.status = 'completed'
GROUP BY a.id""")
def q_last_transaction(spark, sf_dir):
    return A.last_transaction(fx(spark, sf_dir).ledger)


@register("ledger_health", views=("users", "accounts", "transactions"), oracle=f"""
SELECT 'users' AS metric, CAST(COUNT(*) AS VARCHAR) AS value, TIMESTAMP '{HISTORY_AS_OF}' AS measured_at FROM users UNION ALL
SELECT 'accounts', CAST(COUNT(*) AS VARCHAR), TIMESTAMP '{HISTORY_AS_OF}' FROM accounts UNION ALL
SELECT 'transactions', CAST(COUNT(*) AS VARCHAR), TIMESTAMP '{HISTORY_AS_OF}' FROM transactions UNION ALL
SELECT 'active_accounts', CAST(COUNT(*) AS VARCHAR), TIMESTAMP '{HISTORY_AS_OF}' FROM accounts WHERE status = 'active' UNION ALL
SELECT 'pending_transactions', CAST(COUNT(*) AS VARCHAR), TIMESTAMP '{HISTORY_AS_OF}' FROM transactions WHERE status = 'pending' UNION ALL
SELECT 'idle_accounts', CAST(COUNT(*) AS VARCHAR), TIMESTAMP '{HISTORY_AS_OF}' FROM accounts a WHERE a.status = 'active'
  AND NOT EXISTS (SELECT 1 FROM transactions t WHERE t.account_id = a.id AND t.status = 'completed'
    AND t.created_at > TIMESTAMP '{HISTORY_AS_OF}' - INTERVAL 30 DAY AND t.created_at <= TIMESTAMP '{HISTORY_AS_OF}')""")
def q_ledger_health(spark, sf_dir):
    return A.ledger_health(fx(spark, sf_dir).ledger, HISTORY_AS_OF)


@register("max_key", views=("users", "accounts", "transactions", "audit_logs", "alerts", "account_limits",
                            "transfer_queue"), oracle="""
SELECT 'users' AS table_name, MAX(id) AS max_id FROM users UNION ALL
SELECT 'accounts', MAX(id) FROM accounts UNION ALL
SELECT 'transactions', MAX(id) FROM transactions UNION ALL
SELECT 'audit_logs', MAX(id) FROM audit_logs UNION ALL
SELECT 'alerts', MAX(id) FROM alerts UNION ALL
SELECT 'account_limits', MAX(id) FROM account_limits UNION ALL
SELECT 'transfer_queue', MAX(id) FROM transfer_queue""")
def q_max_key(spark, sf_dir):
    return A.max_key(fx(spark, sf_dir).ledger)


@register("creation_and_tx_counters", views=("accounts", "transactions"), oracle="""
SELECT 'account_creations_total' AS metric, CAST(NULL AS VARCHAR) AS label, COUNT(*) AS value FROM accounts UNION ALL
SELECT 'transactions_total', type, COUNT(*) FROM transactions WHERE status = 'completed' AND transfer_ref IS NULL GROUP BY type
UNION ALL
SELECT 'transactions_total', 'transfer', COUNT(DISTINCT transfer_ref) FROM transactions
WHERE status = 'completed' AND transfer_ref IS NOT NULL HAVING COUNT(DISTINCT transfer_ref) > 0""")
def q_creation_and_tx_counters(spark, sf_dir):
    return M.activity_counters(fx(spark, sf_dir).ledger)


_BUCKETS = ", ".join(f"({i}, '{b}', CAST('{b}' AS DECIMAL(10,4)))" for i, b in enumerate(M.DEFAULT_BUCKETS))


@register("duration_histogram", views=("request_log",), oracle=f"""
SELECT g.method, g.route, g.status_code, b.le,
  (SELECT COUNT(*) FROM request_log r WHERE r.method = g.method AND r.route = g.route
     AND r.status_code = g.status_code AND (b.bound IS NULL OR r.duration_s <= b.bound)) AS bucket_count,
  g.duration_sum, g.duration_count
FROM (SELECT method, route, status_code, COUNT(*) AS duration_count,
        CAST(SUM(duration_s) AS DECIMAL(20,4)) AS duration_sum FROM request_log GROUP BY 1, 2, 3) g,
     (VALUES {_BUCKETS}, ({len(M.DEFAULT_BUCKETS)}, '+Inf', NULL)) AS b(pos, le, bound)""")
def q_duration_histogram(spark, sf_dir):
    return M.duration_histogram(fx(spark, sf_dir)["request_log"])


# --------------------------------------------------------------------------- sort / limit / windows
@register("transaction_history", views=("accounts", "transactions"), oracle=f"""
SELECT t.id AS transaction_id, t.type, t.amount, t.description, t.status, t.balance_after, t.created_at,
  t.reference_number
FROM transactions t JOIN accounts a ON t.account_id = a.id WHERE a.account_number = '{PAGE_ACCOUNT}'
ORDER BY t.created_at DESC NULLS FIRST, t.id DESC LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}""")
def q_transaction_history(spark, sf_dir):
    return W.transaction_history(fx(spark, sf_dir).ledger, PAGE_ACCOUNT, PAGE_LIMIT, PAGE_OFFSET)


@register("transaction_history_all", views=("accounts", "transactions"), oracle=f"""
SELECT a.account_number, t.id AS transaction_id, t.type, t.amount, t.description, t.status, t.balance_after,
  t.created_at, t.reference_number, t.position
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC NULLS FIRST, id DESC) AS position
      FROM transactions) t JOIN accounts a ON t.account_id = a.id
WHERE t.position > {PAGE_OFFSET} AND t.position <= {PAGE_OFFSET + PAGE_LIMIT}""")
def q_transaction_history_all(spark, sf_dir):
    return W.transaction_history_all(fx(spark, sf_dir).ledger, PAGE_LIMIT, PAGE_OFFSET)


RUNNING_SQL = f"""
SELECT id, account_id, type, amount, created_at,
  CAST(after - signed AS DECIMAL(15,2)) AS balance_before, CAST(after AS DECIMAL(15,2)) AS balance_after
FROM (SELECT *, SUM(signed) OVER (PARTITION BY account_id ORDER BY created_at, id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
      FROM (SELECT id, account_id, type, amount, created_at, {SIGNED_SQL} AS signed
            FROM transactions WHERE status = 'completed'))"""


@register("running_balance", views=("transactions",), oracle=RUNNING_SQL)
def q_running_balance(spark, sf_dir):
    return W.running_balance(fx(spark, sf_dir).ledger.transactions)


@register("balance_as_of", views=("transactions",), oracle=f"""
SELECT account_id, balance_after AS balance FROM (
  SELECT account_id, balance_after,
    row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS rn
  FROM ({RUNNING_SQL}) WHERE created_at <= TIMESTAMP '{POINT_IN_TIME}') WHERE rn = 1""")
def q_balance_as_of(spark, sf_dir):
    posted = W.running_balance(fx(spark, sf_dir).ledger.transactions)
    return W.balance_as_of(posted, POINT_IN_TIME)
