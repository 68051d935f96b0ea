"""Benchmark: the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query runs three times; every run executes the whole plan into Spark's
``noop`` sink (no collect to the driver), and a posting query all of its outputs
(results, transactions, accounts, alerts, audit rows, limits). Prints one JSON line with the median
seconds per query and their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline import fixtures  # noqa: E402
from ledgerline.operators import posting  # noqa: E402
from ledgerline.plans import catalog  # noqa: E402
from ledgerline.session import local_session  # noqa: E402

HEADLINE = [
    "account_summaries",
    "daily_transaction_summary",
    "transaction_history_all",
    "balance_reconciliation",
    "post_withdrawals",
    "post_mixed",
]
RUNS = 3
OUTPUTS = ("results", "transactions", "accounts", "alerts", "audit_logs", "account_limits")


def frames(spark, key: str, sf_dir: str) -> list:
    """The frames that a run of the query writes."""
    if not key.startswith("post_"):
        return [catalog.REGISTRY[key].run(spark, sf_dir)]
    f = fixtures.build(spark, sf_dir)
    requests = f["post_requests"] if key == "post_mixed" else f["post_requests"].where("op = 'withdrawal'")
    outcome = posting.post(requests, f.ledger, catalog.AS_OF)
    return [getattr(outcome, name) for name in OUTPUTS]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="ledgerline-bench")
    times: dict[str, float] = {}
    for key in HEADLINE:
        samples = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            for df in frames(spark, key, sf_dir):
                df.write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[key] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
