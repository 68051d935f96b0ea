"""Stateless ledger jobs (T5-T13): account creation and closing, interest,
limit resets, session expiry, audit and timestamp triggers, debit checks and
alert rules. Each is a join plus column rules over whole tables; new rows get
ids that continue after the table's maximum, derived from the request id so a
replayed batch mints the same ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expressions as X
from ..schemas import MONEY
from ..sources.ledger import Ledger
from .joins import default_limits


def _base(df: DataFrame, name: str) -> DataFrame:
    """One-row frame ``(_k, name)`` holding ``max(id) + 1`` of a table."""
    return df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias(name), F.lit(1).alias("_k"))


def _with_bases(df: DataFrame, *bases: DataFrame) -> DataFrame:
    out = df.withColumn("_k", F.lit(1))
    for b in bases:
        out = out.join(F.broadcast(b), "_k")  # one-row frames
    return out.drop("_k")


@dataclass(frozen=True)
class Created:
    results: DataFrame
    accounts: DataFrame
    transactions: DataFrame
    account_limits: DataFrame
    audit_logs: DataFrame


def create_accounts(requests: DataFrame, ledger: Ledger, as_of: str, rules: str = "procedure") -> Created:
    """T5: open accounts for existing users.

    ``requests``: request_id, user_id, account_type, initial_balance. Rejects
    an unknown user (``user_not_found``, an EXISTS test as a left join to the
    distinct user ids) and a negative opening balance. An accepted account is
    active, numbered ``KB`` + run time + request id (F8), gets an ``Initial
    deposit`` transaction when the opening balance is positive and, under
    procedure rules, the three default limits (J9) and an ``account_created``
    audit row. Type defaults: ``checking`` (procedure) / ``savings`` (table
    default, api) (D11). Ids: ``max + request_id`` (accounts, audit),
    ``max + 2 * request_id`` (transactions), ``max + 3 * request_id + k`` (limits)."""
    now = X.ts_literal(as_of)
    known = ledger.users.select(F.col("id").alias("_uid")).distinct().withColumn("_hit", F.lit(True))
    r = requests.join(known, requests.user_id == known._uid, "left")
    opening = F.coalesce(F.col("initial_balance"), F.lit(0).cast(MONEY))
    reason = F.when(F.col("_hit").isNull(), F.lit("user_not_found")).when(opening < 0, F.lit("negative_initial_balance"))
    r = _with_bases(r.withColumn("reason", reason).withColumn("opening", opening),
                    _base(ledger.accounts, "_ab"), _base(ledger.transactions, "_tb"),
                    _base(ledger.account_limits, "_lb"), _base(ledger.audit_logs, "_xb"))
    default_type = "checking" if rules == "procedure" else "savings"
    r = r.withColumn("account_id", F.col("_ab") + F.col("request_id")).withColumn(
        "account_number", X.new_account_number(now, F.col("request_id"))
    ).withColumn("account_type", F.coalesce("account_type", F.lit(default_type)))
    ok = F.col("reason").isNull()
    results = r.select(
        "request_id", ok.alias("accepted"), "reason",
        F.when(ok, F.col("account_id")).alias("account_id"),
        F.when(ok, F.col("account_number")).alias("account_number"),
        F.when(ok, F.col("opening")).cast(MONEY).alias("balance"),
    )
    good = r.where(ok)
    accounts = schemas.conform(good.select(
        F.col("account_id").alias("id"), "user_id", "account_number", "account_type",
        F.col("opening").alias("balance"), F.lit("USD").alias("currency"), F.lit("active").alias("status"),
        F.lit(0).alias("overdraft_limit"), F.lit(0).alias("interest_rate"),
        now.alias("created_at"), now.alias("updated_at"),
    ), schemas.TABLES["accounts"])
    tx = schemas.conform(good.where(F.col("opening") > 0).select(
        (F.col("_tb") + 2 * F.col("request_id")).alias("id"), F.col("account_id"), F.lit("deposit").alias("type"),
        F.col("opening").alias("amount"), F.lit(0).alias("balance_before"), F.col("opening").alias("balance_after"),
        F.lit(X.INITIAL_DEPOSIT_DESCRIPTION).alias("description"),
        X.stable_uuid(F.lit("open"), F.col("_tb") + 2 * F.col("request_id")).alias("reference_number"),
        F.lit("completed").alias("status"), now.alias("created_at"), now.alias("completed_at"),
    ), schemas.TABLES["transactions"])
    if rules == "procedure":
        lim = default_limits(good, "account_id", ("request_id", "_lb")).select(
            (F.col("_lb") + 3 * F.col("request_id") + F.col("k")).alias("id"), "account_id", "limit_type", "amount",
            "period", F.lit(0).alias("current_usage"), now.alias("created_at"), now.alias("updated_at"))
        audit = good.select(
            (F.col("_xb") + F.col("request_id")).alias("id"), "user_id", "account_id",
            F.lit(X.AUDIT_ACCOUNT_CREATED).alias("action"), F.lit(X.AUDIT_ENTITY_ACCOUNT).alias("entity_type"),
            F.col("account_id").alias("entity_id"),
            X.json_object(account_number=F.col("account_number"), type=F.col("account_type"),
                          balance=F.col("opening")).alias("new_values"),
            now.alias("created_at"),
        )
    else:  # D12: the API makes neither limits nor an audit row
        lim = ledger.account_limits.limit(0)
        audit = ledger.audit_logs.limit(0)
    return Created(results, accounts, tx, schemas.conform(lim, schemas.TABLES["account_limits"]),
                   schemas.conform(audit, schemas.TABLES["audit_logs"]))


@dataclass(frozen=True)
class Opened:
    results: DataFrame
    users: DataFrame
    accounts: DataFrame
    transactions: DataFrame


def open_accounts(requests: DataFrame, ledger: Ledger, as_of: str) -> Opened:
    """T5, the REST path: each request creates its user and the user's first account.

    ``requests``: request_id, first_name, last_name, email, initial_deposit.
    Rejects ``missing_fields``, ``invalid_email``, ``invalid_initial_deposit``
    and ``duplicate_email`` (emails are unique: a user has it, or an earlier valid
    request of the batch takes it). The account is active with the table's type
    default; a positive deposit is its ``Initial deposit`` transaction. No
    limits and no audit rows (D12). Ids: ``max + 1 + request_id``
    (users, accounts), ``max + 1 + 2 * request_id`` (transactions)."""
    now = X.ts_literal(as_of)

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    why = (F.when(blank("first_name") | blank("last_name") | blank("email"), F.lit("missing_fields"))
           .when(~X.valid_email("email", "api"), F.lit("invalid_email"))
           .when(F.col("initial_deposit") < 0, F.lit("invalid_initial_deposit")))
    r = requests.withColumn("reason", why)
    taken = ledger.users.select(F.col("email").alias("_te")).where("_te IS NOT NULL").distinct()
    first = r.where(F.col("reason").isNull()).groupBy(F.col("email").alias("_fe")).agg(F.min("request_id").alias("_first"))
    r = r.join(taken, F.col("email") == F.col("_te"), "left").join(first, F.col("email") == F.col("_fe"), "left")
    late = F.col("_te").isNotNull() | (F.col("request_id") != F.col("_first"))
    r = r.withColumn("reason", F.when(F.col("reason").isNull() & late, F.lit("duplicate_email")).otherwise(F.col("reason")))
    r = _with_bases(r, _base(ledger.users, "_ub"), _base(ledger.accounts, "_ab"), _base(ledger.transactions, "_tb"))
    r = r.withColumns({
        "user_id": F.col("_ub") + F.col("request_id"), "account_id": F.col("_ab") + F.col("request_id"),
        "account_number": X.new_account_number(now, F.col("request_id")),
        "opening": F.coalesce(F.col("initial_deposit"), F.lit(0)).cast(MONEY)})
    ok = F.col("reason").isNull()
    results = r.select("request_id", ok.alias("accepted"), "reason", *[
        F.when(ok, F.col(c)).alias(c) for c in ("user_id", "account_id", "account_number")], F.when(ok, F.col("opening")).alias("balance"))
    good = r.where(ok)
    users = schemas.conform(good.select(F.col("user_id").alias("id"), "first_name", "last_name", "email", now.alias("created_at")), schemas.TABLES["users"])
    accounts = schemas.conform(good.select(
        F.col("account_id").alias("id"), "user_id", "account_number", F.lit("savings").alias("account_type"), F.col("opening").alias("balance"),
        F.lit("USD").alias("currency"), F.lit("active").alias("status"), F.lit(0).alias("overdraft_limit"), F.lit(0).alias("interest_rate"),
        now.alias("created_at"), now.alias("updated_at")), schemas.TABLES["accounts"])
    tx_id = F.col("_tb") + 2 * F.col("request_id")
    tx = schemas.conform(good.where(F.col("opening") > 0).select(
        tx_id.alias("id"), "account_id", F.lit("deposit").alias("type"), F.col("opening").alias("amount"),
        F.lit(X.INITIAL_DEPOSIT_DESCRIPTION).alias("description"), X.stable_uuid(F.lit("open"), tx_id).alias("reference_number"),
        F.lit("completed").alias("status"), now.alias("created_at")), schemas.TABLES["transactions"])
    return Opened(results, users, accounts, tx)


@dataclass(frozen=True)
class Closed:
    results: DataFrame
    accounts: DataFrame
    audit_logs: DataFrame


def close_accounts(requests: DataFrame, ledger: Ledger, as_of: str) -> Closed:
    """Close active accounts with a zero balance.

    ``requests``: request_id, account_number, reason (NULL = ``Customer
    request``). Rejects ``account_not_found`` (missing, not active, or closed
    by an earlier request of the batch) and ``non_zero_balance``. The first
    request per number is found with a map-side ``min`` (no per-number window)."""
    now = X.ts_literal(as_of)
    first = requests.groupBy(F.col("account_number").alias("_fn")).agg(F.min("request_id").alias("_first"))
    act = ledger.accounts.where(F.col("status") == "active").select(
        F.col("account_number").alias("_an"), F.col("id").alias("account_id"), "balance", "user_id")
    r = (requests.join(first, F.col("account_number") == F.col("_fn"), "left")
         .join(act, F.col("account_number") == F.col("_an"), "left"))
    # A repeat of a number sees what its first request left: still active with
    # the same balance (first rejected) or closed (first accepted).
    why = (F.when(F.col("account_id").isNull(), F.lit("account_not_found"))
           .when(F.col("balance") != 0, F.lit("non_zero_balance"))
           .when(F.col("request_id") != F.col("_first"), F.lit("account_not_found")))
    r = r.withColumn("reject", why)
    results = r.select("request_id", "account_number", F.col("reject").isNull().alias("accepted"),
                       F.col("reject").alias("reason"))
    closed = r.where(F.col("reject").isNull())
    ids = closed.select(F.col("account_id").alias("_cid"))
    a = ledger.accounts.join(ids, F.col("id") == F.col("_cid"), "left")
    hit = F.col("_cid").isNotNull()
    accounts = a.select(*[
        F.when(hit, F.lit("closed")).otherwise(F.col("status")).alias(c) if c == "status"
        else F.when(hit, now).otherwise(F.col(c)).alias(c) if c in ("closed_at", "updated_at")
        else F.col(c) for c in ledger.accounts.columns
    ])
    audit = _with_bases(closed, _base(ledger.audit_logs, "_xb")).select(
        (F.col("_xb") + F.col("request_id")).alias("id"), "user_id", "account_id",
        F.lit(X.AUDIT_ACCOUNT_CLOSED).alias("action"), F.lit(X.AUDIT_ENTITY_ACCOUNT).alias("entity_type"),
        F.col("account_id").alias("entity_id"),
        X.json_object(status=F.lit("active")).alias("old_values"),
        X.json_object(status=F.lit("closed"), closed_at=now).alias("new_values"),
        now.alias("created_at"),
        X.json_object(reason=F.coalesce("reason", F.lit(X.DEFAULT_CLOSE_REASON))).alias("metadata"),
    )
    return Closed(results, accounts, schemas.conform(audit, schemas.TABLES["audit_logs"]))


def monthly_interest(ledger: Ledger) -> DataFrame:
    """``round(balance * rate / 12, 2)`` per account; 0 unless active."""
    return ledger.accounts.select("account_number", _interest().alias("interest"))


def _interest() -> Column:
    return F.when(F.col("status") == "active", X.monthly_interest("balance", F.coalesce("interest_rate", F.lit(0)))).otherwise(
        F.lit(0).cast(MONEY))


def credit_interest(ledger: Ledger) -> DataFrame:
    """A new accounts version with the month's interest added to the balance."""
    return ledger.accounts.select(*[(F.col("balance") + F.coalesce(_interest(), F.lit(0))).cast(MONEY).alias("balance")
                                    if c == "balance" else F.col(c) for c in ledger.accounts.columns])


def reset_daily_limits(limits: DataFrame, as_of: str) -> DataFrame:
    """The new limits version: daily limits due (``reset_at`` NULL or
    passed) get usage 0 and ``reset_at = as_of + 1 day``."""
    now = X.ts_literal(as_of)
    due = (F.col("period") == "daily") & (F.col("reset_at").isNull() | (F.col("reset_at") <= now))
    return limits.select(*[
        F.when(due, F.lit(0).cast(MONEY)).otherwise(F.col(c)).alias(c) if c == "current_usage"
        else F.when(due, now + F.expr("INTERVAL 1 DAY")).otherwise(F.col(c)).alias(c) if c == "reset_at"
        else F.when(due, now).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.col(c) for c in limits.columns
    ])


def reset_count(limits: DataFrame, as_of: str) -> DataFrame:
    """The row count T8 returns."""
    now = X.ts_literal(as_of)
    due = (F.col("period") == "daily") & (F.col("reset_at").isNull() | (F.col("reset_at") <= now))
    return limits.where(due).agg(F.count(F.lit(1)).alias("reset_count"))


def expire_sessions(sessions: DataFrame, as_of: str) -> DataFrame:
    """Active sessions with ``expires_at < as_of`` become inactive."""
    gone = F.col("is_active") & (F.col("expires_at") < X.ts_literal(as_of))
    return sessions.select(*[F.when(gone, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "is_active"
                             else F.col(c) for c in sessions.columns])


def balance_audit(old: DataFrame, new: DataFrame, as_of: str, audit_logs: DataFrame | None = None) -> DataFrame:
    """One ``balance_change`` audit row per account whose balance differs
    between two versions (the AFTER UPDATE trigger, set-at-a-time). Audit ids
    continue after ``audit_logs`` (if given) as ``max + account id``."""
    now = X.ts_literal(as_of)
    o = old.select(F.col("id").alias("_oid"), F.col("balance").alias("_ob"), F.col("updated_at").alias("_ou"))
    j = new.join(o, F.col("id") == F.col("_oid"), "inner").where(F.col("balance") != F.col("_ob"))
    if audit_logs is not None:
        j = _with_bases(j, _base(audit_logs, "_xb"))
    else:
        j = j.withColumn("_xb", F.lit(0).cast("bigint"))
    out = j.select(
        (F.col("_xb") + F.col("id")).alias("id"), F.col("id").alias("account_id"),
        F.lit(X.AUDIT_BALANCE_CHANGE).alias("action"), F.lit(X.AUDIT_ENTITY_ACCOUNT).alias("entity_type"),
        F.col("id").alias("entity_id"),
        X.json_object(balance=F.col("_ob"), updated_at=F.col("_ou")).alias("old_values"),
        X.json_object(balance=F.col("balance"), updated_at=now).alias("new_values"),
        now.alias("created_at"),
    )
    return schemas.conform(out, schemas.TABLES["audit_logs"])


def touch_updated_at(old: DataFrame, new: DataFrame, as_of: str, compare: list[str] | None = None) -> DataFrame:
    """``updated_at = as_of`` on rows of ``new`` that differ from ``old``
    (matched by id) in any compared column (all but ``updated_at`` by default)."""
    cols = compare or [c for c in new.columns if c not in ("id", "updated_at")]
    o = old.select(F.col("id").alias("_oid"), *[F.col(c).alias(f"_o_{c}") for c in cols])
    j = new.join(o, F.col("id") == F.col("_oid"), "left")
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    changed = F.col("_oid").isNotNull() & differs
    return j.select(*[F.when(changed, X.ts_literal(as_of)).otherwise(F.col(c)).alias(c) if c == "updated_at"
                      else F.col(c) for c in new.columns])


def validate_debits(candidates: DataFrame, accounts: DataFrame) -> DataFrame:
    """Candidate ``withdrawal`` / ``transfer`` rows that would take the
    account below ``-overdraft_limit`` at its current balance."""
    a = accounts.select(F.col("id").alias("_aid"), "balance", F.coalesce("overdraft_limit", F.lit(0)).alias("overdraft_limit"))
    j = candidates.where(F.col("type").isin("withdrawal", "transfer")).join(
        a, F.col("account_id") == F.col("_aid"), "inner")
    return j.where((F.col("balance") - F.col("amount")) < -F.col("overdraft_limit")).select(
        F.col("id").alias("transaction_id"), "account_id", "type", "amount", "balance", "overdraft_limit")


def alert_rules(posted: DataFrame, accounts: DataFrame, rule: str) -> DataFrame:
    """One alert rule over posted transaction rows.

    ``large_deposit``: deposit over 10000 (strict); ``low_balance``: withdrawal
    leaving a balance under 100; ``transfer_received``: the credit leg of a
    transfer (it carries a ``transfer_ref``). An alert bears its transaction's id, as in
    posting, and like the procedures' alerts no ``transaction_id``."""
    acc = accounts.select(F.col("id").alias("_aid"), F.col("account_number").alias("_num"), F.col("user_id").alias("_uid"))
    other = accounts.select(F.col("id").alias("_rid"), F.col("account_number").alias("_from"))
    amt = F.col("amount").cast("string")
    if rule == "large_deposit":
        src = posted.where((F.col("type") == "deposit") & (F.col("amount") > X.LARGE_DEPOSIT_THRESHOLD))
        kind, sev, title, fmt = X.ALERT_LARGE_DEPOSIT
        msg = F.format_string(fmt, amt, F.col("_num"))
    elif rule == "low_balance":
        src = posted.where((F.col("type") == "withdrawal") & (F.col("balance_after") < X.LOW_BALANCE_THRESHOLD))
        kind, sev, title, fmt = X.ALERT_LOW_BALANCE
        msg = F.format_string(fmt, F.col("_num"), F.col("balance_after").cast("string"))
    elif rule == "transfer_received":
        src = posted.where((F.col("type") == "deposit") & F.col("transfer_ref").isNotNull())
        src = src.join(other, F.col("related_account_id") == F.col("_rid"), "left")
        kind, sev, title, fmt = X.ALERT_TRANSFER_RECEIVED
        msg = F.format_string(fmt, amt, F.col("_from"))
    else:
        raise ValueError(rule)
    j = src.join(acc, F.col("account_id") == F.col("_aid"), "inner")
    out = j.select(
        F.col("id"), F.col("_uid").alias("user_id"), "account_id",
        F.lit(kind).alias("type"), F.lit(sev).alias("severity"), F.lit(title).alias("title"), msg.alias("message"),
        F.lit(False).alias("is_read"), "created_at",
    )
    return schemas.conform(out, schemas.TABLES["alerts"])


def all_alerts(posted: DataFrame, accounts: DataFrame) -> DataFrame:
    out = None
    for rule in ("large_deposit", "low_balance", "transfer_received"):
        part = alert_rules(posted, accounts, rule)
        out = part if out is None else out.unionByName(part)
    return out
