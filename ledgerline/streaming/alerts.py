"""Alert rules on a stream of posted transaction rows.

Stateless: each rule is a filter plus a stream-static join to the accounts
(for the holder and the account number), so no state store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators.jobs import all_alerts


def stream_alerts(posted_stream: DataFrame, accounts: DataFrame) -> DataFrame:
    """The T13 rules applied to a streaming (or batch) frame of posted rows."""
    return all_alerts(posted_stream, accounts)


def run_stream_alerts(spark: SparkSession, source_dir: str, accounts: DataFrame, sink_dir: str,
                      checkpoint_location: str):
    """Read posted rows from ``source_dir`` as a stream and append alerts to ``sink_dir``."""
    stream = spark.readStream.schema(schemas.table_schema("transactions")).parquet(source_dir)
    return (
        stream_alerts(stream, accounts).writeStream.format("parquet")
        .option("path", sink_dir).option("checkpointLocation", checkpoint_location)
        .outputMode("append").trigger(availableNow=True).start()
    )
