"""Clients above a request rate (X2): the API's rate limit as an aggregate.

Works on a batch or a streaming request log: ``withWatermark`` bounds the
state kept for late rows, windows are tumbling and epoch-aligned.

:func:`stream_rate_decisions` is the limiter itself: it admits or refuses each request of the stream
as it arrives, with a counter per client and window in keyed state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .posting import _TIMES, rocksdb_state

# The API's limit, 100 requests per 15 minutes per client.
DEFAULT_MAX_REQUESTS = 100
DEFAULT_WINDOW = "15 minutes"
DEFAULT_MINUTES = 15


def request_rate_breaches(log: DataFrame, max_requests: int = DEFAULT_MAX_REQUESTS,
                          window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WINDOW) -> DataFrame:
    """(window_start, window_end, ip, requests) where requests > max_requests.

    Watermarks need a zone-aware event time: a zone-less ``ts`` is read as UTC
    (the session zone) for windowing and the bounds are returned in its type."""
    ts_type = log.schema["ts"].dataType
    counted = (
        log.withColumn("_et", F.col("ts").cast("timestamp_ltz"))
        .withWatermark("_et", watermark)
        .groupBy(F.window("_et", window).alias("w"), "ip")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counted.where(F.col("requests") > int(max_requests)).select(
        F.col("w.start").cast(ts_type).alias("window_start"), F.col("w.end").cast(ts_type).alias("window_end"),
        "ip", "requests")


def stream_rate_breaches(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_location: str,
                         max_requests: int = DEFAULT_MAX_REQUESTS, max_files_per_trigger: int = 100):
    """Start the rate check on request-log files that arrive in ``source_dir``. Each
    micro-batch writes the windows that it changed to its own folder of
    ``sink_dir`` (a repeated one overwrites it); the watermark bounds the state."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(max_files_per_trigger)).parquet(source_dir)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch_id}")

    return (
        request_rate_breaches(log, max_requests).writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
    )


def written_breaches(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The breaches that the stream has written: a window's count only grows, so its last is its largest."""
    rows = spark.read.option("basePath", sink_dir).parquet(f"{sink_dir}/epoch=*")
    return rows.groupBy("window_start", "window_end", "ip").agg(F.max("requests").alias("requests"))


#: Parts of a window's clients; a part's counters are read and written together (a state call per client costs about a
#: millisecond). Fixed for the life of a checkpoint.
CLIENT_PARTS = 16


def _limiter(max_requests: int):
    """The processor of a part of one window's clients; a local class, so workers need not import this package."""
    from bisect import insort

    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Limiter(StatefulProcessor):
        def init(self, handle):
            self.admitted = handle.getValueState("admitted", "ips array<string>, n array<int>")

        def handleInputRows(self, key, rows, timerValues):
            before = dict(zip(*self.admitted.get())) if self.admitted.exists() else {}
            earliest = {}  # by client the earliest requests so far, at most as many as may still pass
            for r in rows:
                first = earliest.setdefault(r.ip, [])
                insort(first, (r.at is not None, r.at or 0, r.request))
                if len(first) > max_requests - before.get(r.ip, 0):
                    yield Row(request=first.pop()[2], position=None)
            passed = False
            for ip, first in earliest.items():
                n = before.get(ip, 0)
                for i, (_, _, request) in enumerate(first):
                    yield Row(request=request, position=n + i + 1)
                if first:
                    before[ip], passed = n + len(first), True
            if passed:
                self.admitted.update((list(before), list(before.values())))

        def close(self):
            pass

    return Limiter()


def rate_decisions(log: DataFrame, max_requests: int = DEFAULT_MAX_REQUESTS, minutes: int = DEFAULT_MINUTES) -> DataFrame:
    """The requests of a stream (columns ``ts``, ``ip`` and any others), each with ``position``, its number among the
    admitted ones of its client and window, or NULL where it is refused: the window had admitted ``max_requests``.

    Within a micro-batch the earliest requests are admitted (ties: by their other columns), across
    micro-batches the ones that came first. A task holds at most ``max_requests`` requests of a client and
    window, however many come, for a ``CLIENT_PARTS``-th of one window's clients at a time. Requests without ``ip`` are one client; those without ``ts`` share one window.
    The counters (one number per client and window, in one state row per window and part of its clients) stay for ever: expiry needs processing time, under which a run
    over the files at hand (``availableNow``) would not end."""
    at = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    start = F.floor(at / F.lit(minutes * 60_000_000)).cast("bigint")
    request = F.to_json(F.struct(*[F.col(c) for c in log.columns]), _TIMES)
    part = F.pmod(F.xxhash64("ip"), F.lit(CLIENT_PARTS)).alias("part")
    keyed = log.select("ip", start.alias("window"), part, at.alias("at"), request.alias("request")).groupBy("window", "part")
    decided = keyed.transformWithState(_limiter(int(max_requests)), "request string, position int", "append", "none")
    return decided.select(F.from_json("request", log.schema, _TIMES).alias("r"), "position").select("r.*", "position")


def stream_rate_decisions(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str, checkpoint_location: str,
                          max_requests: int = DEFAULT_MAX_REQUESTS, minutes: int = DEFAULT_MINUTES,
                          max_files_per_trigger: int = 100):
    """Start the limiter on request-log files that arrive in ``source_dir``; each request's decision is appended to
    ``sink_dir`` once (the file sink's log drops what a repeated micro-batch wrote)."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(max_files_per_trigger)).parquet(source_dir)
    with rocksdb_state(spark):
        return (
            rate_decisions(log, max_requests, minutes).writeStream.format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_location).outputMode("append").trigger(availableNow=True).start()
        )
