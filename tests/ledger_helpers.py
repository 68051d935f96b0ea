"""Small ledgers and request frames, and the paths of the test tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.sources.ledger import Ledger, empty_table

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def make_ledger(spark, accounts, limits=(), users=None):
    """A small ledger from row dicts (unit tests of the reference's value vectors)."""
    acc_rows = [
        {
            "id": a["id"], "user_id": a.get("user_id", a["id"]), "account_number": a["account_number"],
            "account_type": a.get("account_type", "checking"), "balance": Decimal(str(a["balance"])),
            "currency": "USD", "status": a.get("status", "active"),
            "overdraft_limit": Decimal(str(a.get("overdraft_limit", 0))), "interest_rate": Decimal("0"),
        }
        for a in accounts
    ]
    acc = spark.createDataFrame(acc_rows, "id long, user_id long, account_number string, account_type string, "
                                "balance decimal(15,2), currency string, status string, overdraft_limit decimal(15,2), "
                                "interest_rate decimal(5,4)")
    us = users or [{"id": a.get("user_id", a["id"]), "email": f"u{a['id']}@example.com"} for a in accounts]
    usr = spark.createDataFrame([(u["id"], "First", "Last", u["email"]) for u in us],
                                "id long, first_name string, last_name string, email string")
    lim = spark.createDataFrame(
        [(i + 1, l["account_id"], l.get("limit_type", "daily_withdrawal"), Decimal(str(l["amount"])),
          l.get("period", "daily"), Decimal(str(l.get("current_usage", 0)))) for i, l in enumerate(limits)],
        "id long, account_id long, limit_type string, amount decimal(15,2), period string, current_usage decimal(15,2)",
    )
    tables = {t: empty_table(spark, t) for t in schemas.LEDGER_TABLES}
    tables["accounts"] = schemas.conform(acc, schemas.TABLES["accounts"])
    tables["users"] = schemas.conform(usr, schemas.TABLES["users"])
    tables["account_limits"] = schemas.conform(lim, schemas.TABLES["account_limits"])
    return Ledger(**tables)


def make_requests(spark, rows):
    """Posting requests from tuples (id, 'yyyy-mm-dd hh:mm:ss', number, op, to, amount)."""
    data = [(rid, ts, num, op, to, None if amt is None else Decimal(str(amt)), None) for rid, ts, num, op, to, amt in rows]
    df = spark.createDataFrame(data, "request_id long, requested_at string, account_number string, op string, "
                                     "to_account string, amount decimal(15,2), description string")
    return schemas.conform(df.withColumn("requested_at", F.to_timestamp("requested_at")), schemas.REQUESTS)
