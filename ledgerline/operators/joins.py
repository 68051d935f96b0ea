"""Joins (J1-J10).

Every join here is an equi-join on a key. Catalyst/AQE choose broadcast or
sort-merge from sizes; we only force ``broadcast`` where the side is bounded
by construction (a literal key list). Semi/anti joins replace ``IN`` /
``NOT IN`` / ``EXISTS`` so no null-aware anti join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MONEY
from ..sources.ledger import Ledger


def accounts_with_users(ledger: Ledger) -> DataFrame:
    """Inner join account to holder."""
    u = ledger.users.select(F.col("id").alias("user_id"), "first_name", "last_name", "email")
    return ledger.accounts.select(F.col("id").alias("account_id"), "account_number", "user_id").join(
        u, "user_id", "inner"
    )


def accounts_left_tx(ledger: Ledger) -> DataFrame:
    """Every account with each of its transactions, or one NULL row."""
    t = ledger.transactions.select(
        F.col("account_id").alias("_aid"), F.col("id").alias("transaction_id"), "type", "amount"
    )
    a = ledger.accounts.select(F.col("id").alias("account_id"), "account_number")
    return _accounts_left(a, t)


def _accounts_left(a: DataFrame, t: DataFrame) -> DataFrame:
    """Accounts LEFT JOIN the fact rows ``t`` (key ``_aid``), as the inner join and the
    accounts without a row. With the fact table on the left of an inner join AQE can
    split a hot account, which it can't on the right of a left join; the anti
    join meets distinct account ids only."""
    inner = t.join(a, F.col("_aid") == F.col("account_id"), "inner").drop("_aid")
    seen = t.select("_aid").distinct()
    alone = a.join(seen, F.col("account_id") == F.col("_aid"), "left_anti")
    return inner.select(*a.columns, *[c for c in t.columns if c != "_aid"]).unionByName(alone, allowMissingColumns=True)


def tx_for_account(ledger: Ledger, account_numbers: list[str] | None = None) -> DataFrame:
    """Transactions joined to their account by account number.

    With a literal list of numbers the account side holds at most that many
    rows (numbers are unique), so it is broadcast; without one the whole
    account table joins and AQE picks the strategy from runtime sizes."""
    a = ledger.accounts.select(F.col("id").alias("_aid"), "account_number")
    if account_numbers is not None:
        a = F.broadcast(a.where(F.col("account_number").isin(list(account_numbers))))
    t = ledger.transactions.select(
        F.col("id").alias("transaction_id"), "account_id", "type", "amount", "status", "created_at"
    )
    return t.join(a, t.account_id == a._aid, "inner").drop("_aid")


def left_join_on_status(ledger: Ledger, status: str = "completed") -> DataFrame:
    """The status test sits in the ON clause, so accounts with no row of
    that status still appear (with NULLs)."""
    a = ledger.accounts.select(F.col("id").alias("account_id"), "account_number")
    t = ledger.transactions.select(
        F.col("account_id").alias("_aid"), F.col("id").alias("transaction_id"), "amount", "status"
    )
    return _accounts_left(a, t.where(F.col("status") == status).drop("status"))


def orphan_accounts(ledger: Ledger) -> DataFrame:
    """Accounts whose user is missing (``NOT IN`` as an anti join; the
    keys are NOT NULL in the schema, so the two agree)."""
    u = ledger.users.select(F.col("id").alias("user_id"))
    return ledger.accounts.join(u, "user_id", "left_anti").select(
        F.col("id").alias("account_id"), "user_id", "account_number"
    )


def user_exists(requests: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """EXISTS test per request row, as a boolean column ``user_exists``."""
    known = users.select(F.col("id").alias("_uid")).distinct().withColumn("_hit", F.lit(True))
    return requests.join(known, requests[user_col] == known._uid, "left").select(
        *[requests[c] for c in requests.columns],
        F.coalesce(F.col("_hit"), F.lit(False)).alias("user_exists"),
    )


def transfer_pair_lookup(ledger: Ledger, transfers: DataFrame, rules: str = "procedure") -> DataFrame:
    """Both accounts of each transfer request; fewer than two found is a reject.

    ``procedure`` rules look up active accounts only; ``api`` rules any status
    (the API's ``= ANY`` lookup)."""
    acc = ledger.accounts
    if rules == "procedure":
        acc = acc.where(F.col("status") == "active")
    src = acc.select(F.col("account_number").alias("_fn"), F.col("id").alias("from_account_id"),
                     F.col("balance").alias("from_balance"))
    dst = acc.select(F.col("account_number").alias("_tn"), F.col("id").alias("to_account_id"),
                     F.col("balance").alias("to_balance"))
    out = (
        transfers.select("request_id", "account_number", "to_account", "amount")
        .join(src, F.col("account_number") == F.col("_fn"), "left")
        .join(dst, F.col("to_account") == F.col("_tn"), "left")
    )
    found = F.col("from_account_id").isNotNull().cast("int") + F.col("to_account_id").isNotNull().cast("int")
    return out.select(
        "request_id", "from_account_id", "to_account_id", "from_balance", "to_balance",
        found.alias("accounts_found"), (found == 2).alias("pair_found"),
    )


def limit_lookup(accounts: DataFrame, limits: DataFrame, limit_type: str, as_of: str) -> DataFrame:
    """The enforced limit of one type per account (NULLs when none).

    A limit is enforced while ``reset_at`` is NULL or later than ``as_of``;
    with several matching rows the one with the lowest id wins. The limit side
    is reduced to one row per account (partial aggregation) before the join."""
    live = limits.where(
        (F.col("limit_type") == limit_type)
        & (F.col("reset_at").isNull() | (F.col("reset_at") > F.to_timestamp(F.lit(as_of))))
    )
    one = live.groupBy(F.col("account_id").alias("_aid")).agg(
        F.min_by(F.struct(F.col("id").alias("limit_id"), F.col("amount").alias("limit_amount"),
                          F.col("current_usage").alias("current_usage")), F.col("id")).alias("_l")
    )
    return accounts.select(F.col("id").alias("account_id")).join(
        one, F.col("account_id") == F.col("_aid"), "left"
    ).select("account_id", "_l.limit_id", "_l.limit_amount", "_l.current_usage")


# The three limits every new account gets (type, amount, period).
DEFAULT_LIMITS = [
    ("daily_withdrawal", "1000.00", "daily"),
    ("daily_transfer", "5000.00", "daily"),
    ("single_transaction", "2000.00", "transaction"),
]


def default_limits(new_accounts: DataFrame, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each new account times the three default limits. ``keep``: columns to carry along.

    Written as an explode of a three-element literal array (a narrow,
    per-row expansion), not as a join."""
    arr = F.array(*[
        F.struct(F.lit(i).alias("k"), F.lit(t).alias("limit_type"), F.lit(a).cast(MONEY).alias("amount"),
                 F.lit(p).alias("period"))
        for i, (t, a, p) in enumerate(DEFAULT_LIMITS)
    ])
    return new_accounts.select(F.col(id_col).alias("account_id"), *keep, F.explode(arr).alias("_l")).select(
        "account_id", *keep, "_l.k", "_l.limit_type", "_l.amount", "_l.period"
    )


def purge_accounts(ledger: Ledger, doomed: DataFrame) -> Ledger:
    """Delete accounts and every row that references them.

    ``doomed`` holds account ids in its first column. Transactions, alerts,
    limits and audit rows of the accounts go (the reference's own clean-up
    deletes audit rows before their account), and so do queue transfers on either
    side; what other accounts' transactions, alerts and audit rows say of a purged account
    or of its transactions becomes NULL, so no reference dangles. Each child table is an anti join
    on its reference column."""
    ids = doomed.select(F.col(doomed.columns[0]).alias("_pid")).distinct()

    def drop_by(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids, df[column] == ids._pid, "left_anti")

    def forget(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
        marked = df.join(gone.select(F.col(gone.columns[0]).alias("_gone")), df[column] == F.col("_gone"), "left")
        return marked.select(*[F.when(F.col("_gone").isNull(), df[c]).alias(c) if c == column else df[c] for c in df.columns])

    lost = ledger.transactions.join(ids, F.col("account_id") == F.col("_pid"), "left_semi").select(F.col("id").alias("_tid"))
    tx = forget(forget(drop_by(ledger.transactions, "account_id"), "related_account_id", ids), "related_transaction_id", lost)
    queue = drop_by(drop_by(ledger.transfer_queue, "from_account_id"), "to_account_id")
    return ledger.with_tables(
        accounts=drop_by(ledger.accounts, "id"),
        transactions=tx,
        alerts=forget(drop_by(ledger.alerts, "account_id"), "transaction_id", lost),
        audit_logs=forget(drop_by(ledger.audit_logs, "account_id"), "transaction_id", lost),
        account_limits=drop_by(ledger.account_limits, "account_id"),
        transfer_queue=forget(queue, "transaction_id", lost),
    )
