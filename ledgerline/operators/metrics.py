"""Request and activity metrics (A6, A7): the API's counters and histograms
computed as aggregates over tables instead of in-process.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger

# The histogram's default bucket upper bounds in seconds (the
# metrics client's defaults; the reference passes none).
DEFAULT_BUCKETS = ("0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10")

# Database query type per API route.
QUERY_TYPES = [
    ("POST", "/api/accounts", "account_creation"),
    ("GET", "/api/accounts/:accountNumber", "account_query"),
    ("POST", "/api/transactions", "transaction"),
    ("GET", "/api/accounts/:accountNumber/transactions", "transaction_history"),
    ("POST", "/api/transfers", "transfer"),
]


def activity_counters(ledger: Ledger) -> DataFrame:
    """``account_creations_total`` and ``transactions_total{type}``.

    Counted over completed transactions; the two legs of a transfer share a
    ``transfer_ref`` and count once under ``transfer``, as the API counts a
    transfer request once."""
    done = ledger.transactions.where(F.col("status") == "completed")
    single = (
        done.where(F.col("transfer_ref").isNull())
        .groupBy(F.col("type").alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    transfers = done.where(F.col("transfer_ref").isNotNull()).agg(
        F.count_distinct("transfer_ref").alias("value")
    ).where(F.col("value") > 0).select(F.lit("transfer").alias("label"), "value")
    by_type = single.unionByName(transfers).groupBy("label").agg(F.sum("value").alias("value"))
    created = ledger.accounts.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("account_creations_total").alias("metric"), F.lit(None).cast("string").alias("label"), "value"
    )
    return created.unionByName(
        by_type.select(F.lit("transactions_total").alias("metric"), "label", F.col("value").cast("bigint").alias("value"))
    )


def duration_histogram(log: DataFrame, by: str = "route", buckets=DEFAULT_BUCKETS) -> DataFrame:
    """Cumulative ``le`` buckets plus sum and count of request durations.

    ``by="route"`` groups by (method, route, status_code) like the HTTP
    histogram; ``by="query_type"`` maps successful requests to the database
    query type, like the query-duration histogram.

    Each row gets its bucket index with one ``CASE`` (no per-row explode);
    rows are counted per (group, bucket) with a map-side partial aggregate;
    only the small per-group result is expanded to every ``le`` bound and
    made cumulative."""
    bounds = [Decimal(b) for b in buckets]
    if by == "query_type":
        qt = None
        for m, r, q in QUERY_TYPES:
            cond = (F.col("method") == m) & (F.col("route") == r)
            qt = F.when(cond, F.lit(q)) if qt is None else qt.when(cond, F.lit(q))
        src = log.where(F.col("status_code") < 400).withColumn("query_type", qt).where(F.col("query_type").isNotNull())
        keys = ["query_type"]
    else:
        src = log
        keys = ["method", "route", "status_code"]
    idx = None
    for i, b in enumerate(bounds):
        cond = F.col("duration_s") <= F.lit(b)
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    idx = idx.otherwise(F.lit(len(bounds)))

    per_bucket = src.groupBy(*keys, idx.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_s").alias("_s")
    )
    per_group = per_bucket.groupBy(*keys).agg(
        F.collect_list(F.struct("_b", "_n")).alias("_hist"),  # at most len(bounds)+1 entries
        F.sum("_n").alias("duration_count"),
        F.sum("_s").cast("decimal(20,4)").alias("duration_sum"),
    )
    les = F.array(*[F.lit(str(b)) for b in buckets], F.lit("+Inf"))
    expanded = per_group.select(*keys, "_hist", "duration_count", "duration_sum", F.posexplode(les).alias("_pos", "le"))
    cum = F.aggregate(
        F.filter("_hist", lambda h: h["_b"] <= F.col("_pos")), F.lit(0).cast("bigint"),
        lambda acc, h: acc + h["_n"],
    )
    return expanded.select(*keys, "le", cum.alias("bucket_count"), "duration_sum", "duration_count")
