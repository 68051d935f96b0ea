"""A plain, one-request-at-a-time solver: the test oracle for ordered posting.

It follows the procedure rules directly (no bounds, no rounds), so agreement
with the Spark engine checks the round method end to end.
"""

from __future__ import annotations

from decimal import Decimal


def solve(requests, accounts, limits=None):
    """``requests``: dicts with request_id, requested_at, account_number, op,
    to_account, amount (Decimal or None). ``accounts``: dicts with id,
    account_number, balance, status, overdraft_limit. ``limits``: account id ->
    (limit amount, usage) of the enforced daily withdrawal limit.

    Returns request_id -> (accepted, reason, new_balance) and final balances."""
    limits = dict(limits or {})
    active = {a["account_number"]: a for a in accounts if a["status"] == "active"}
    bal = {a["id"]: Decimal(a["balance"]) for a in accounts}
    usage = {k: Decimal(v[1]) for k, v in limits.items()}
    out = {}
    for r in sorted(requests, key=lambda r: (r["requested_at"], r["request_id"])):
        rid, op, amt = r["request_id"], r["op"], r["amount"]
        src = active.get(r["account_number"])
        if op in ("deposit", "withdrawal"):
            if src is None:
                out[rid] = (False, "account_not_found", None)
                continue
            if amt is None:
                out[rid] = (False, "amount_missing", None)
                continue
            if amt <= 0:
                out[rid] = (False, "invalid_amount", None)
                continue
            a = src["id"]
            if op == "deposit":
                bal[a] += amt
                out[rid] = (True, None, bal[a])
                continue
            od = Decimal(src["overdraft_limit"] or 0)
            if bal[a] - amt < -od:
                out[rid] = (False, "insufficient_funds", None)
                continue
            if a in limits and usage[a] + amt > Decimal(limits[a][0]):
                out[rid] = (False, "daily_limit_exceeded", None)
                continue
            bal[a] -= amt
            if a in usage:
                usage[a] += amt
            out[rid] = (True, None, bal[a])
        elif op == "transfer":
            if r["account_number"] == r["to_account"]:
                out[rid] = (False, "same_account", None)
                continue
            if amt is None:
                out[rid] = (False, "amount_missing", None)
                continue
            if amt <= 0:
                out[rid] = (False, "invalid_amount", None)
                continue
            dst = active.get(r["to_account"])
            if src is None:
                out[rid] = (False, "source_not_found", None)
                continue
            if dst is None:
                out[rid] = (False, "destination_not_found", None)
                continue
            if bal[src["id"]] < amt:
                out[rid] = (False, "insufficient_funds", None)
                continue
            bal[src["id"]] -= amt
            bal[dst["id"]] += amt
            out[rid] = (True, None, bal[src["id"]])
        else:
            out[rid] = (False, "invalid_type", None)
    return out, bal
