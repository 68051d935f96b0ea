"""Posting requests that arrive as a stream.

``readStream`` of request files -> keyed state by request id -> ``foreachBatch`` -> ordered posting
(T4) of the micro-batch against the committed ledger -> the batch appended to the
ledger store (S8: new fact rows, changed state rows, results, commit marker).

**Repeats.** ``transformWithState`` keeps, for each request id ever seen, the digest of its body
(RocksDB state in buckets of ids, part of the stream's checkpoint; it has no horizon). A request
that a producer sends again, in the same file or any later batch, also after a restart, posts once. Another body
under a known id gives one reject row (``duplicate_request``), however often it is sent; two bodies that
first come together post neither.

**Bodies.** :func:`stream_bodies` reads the requests as JSON envelopes (text files) instead of typed rows. What cannot be
posted goes to the dead letters (``rejects``), each line once however often it is sent, under the commit
marker of its micro-batch. A rejected line does not take its request id: a corrected body under that id posts.

**Replays** are harmless: ``foreachBatch`` may run a batch again after a failure, from the same state version,
and the commit marker names the micro-batch, so a repeated one is skipped; an
uncommitted batch folder is overwritten by the retry. The marker also
holds the highest ids, so a micro-batch reads no earlier fact file. Within one micro-batch
requests post in ``(requested_at, request_id)`` order; across micro-batches the file order of the
source decides, so producers write request files in time order.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import posting as P
from ..session import discard, freeze
from ..sources import store as S
from ..sources.requests import posting_requests

RESULTS, REJECTS = "results", "rejects"
RESULT_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("reason", T.StringType()),
    T.StructField("new_balance", schemas.MONEY), T.StructField("transaction_id", T.LongType()),
])
REJECT_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("line", T.StringType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (the setting is read at the start)."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _guard():
    """The processor of a bucket of request ids and rejected lines; a local class, so workers need not import this package.

    The state of a bucket is a list with one packed element per micro-batch that brought something new: appending costs the new ids
    only, and one read serves all ids of the bucket (a state call per id costs about a millisecond)."""
    import hashlib
    from array import array

    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    merge_from = 16  # elements of a bucket that are merged into one

    class Guard(StatefulProcessor):
        def init(self, handle):
            # ids: 8 bytes each, digests: 32 each, in that order; conflicts: ids whose bodies differ; lines: 32 bytes each
            self.seen = handle.getListState("seen", "ids binary, digests binary, conflicts binary, lines binary")

        def handleInputRows(self, key, rows, timerValues):
            known, conflicts, lines, elements = {}, set(), set(), 0
            for packed, digests, refused, letters in self.seen.get():
                elements += 1
                for i, rid in enumerate(array("q", bytes(packed))):
                    known[rid] = bytes(digests[32 * i:32 * i + 32])
                conflicts.update(array("q", bytes(refused)))
                lines.update(bytes(letters[i:i + 32]) for i in range(0, len(letters), 32))
            new, new_conflicts, new_lines = {}, [], []
            for r in rows:
                if r.rejected is not None:  # a rejected line
                    line = bytes.fromhex(r.rejected)
                    if line not in lines:
                        lines.add(line)
                        new_lines.append(line)
                        yield Row(request_id=None, rejected=r.rejected, body=r.body, conflict=False)
                    continue
                if r.request_id is None:  # refused each by the batch
                    yield Row(request_id=None, rejected=None, body=r.body, conflict=False)
                    continue
                rid, own = r.request_id, hashlib.sha256(r.body.encode()).digest()
                digest = known.get(rid)
                if digest is None:
                    first = new.get(rid)
                    if first is None:
                        new[rid] = (own, r.body)
                        continue
                    digest = first[0]
                    if r.body < first[1]:
                        new[rid] = (digest, r.body)
                if own != digest and rid not in conflicts:  # the first other body
                    conflicts.add(rid)
                    new_conflicts.append(rid)
                    if rid in known:
                        yield Row(request_id=rid, rejected=None, body=r.body, conflict=True)
            for rid, (_, least) in new.items():
                yield Row(request_id=rid, rejected=None, body=least, conflict=rid in conflicts)
            if not (new or new_conflicts or new_lines):
                return
            if elements + 1 < merge_from:
                parts = list(new), [d for d, _ in new.values()], new_conflicts, new_lines
            else:
                parts = [*known, *new], [*known.values(), *(d for d, _ in new.values())], conflicts, lines
            ids, digests, refused, letters = parts
            element = (array("q", ids).tobytes(), b"".join(digests), array("q", refused).tobytes(), b"".join(letters))
            self.seen.put([element]) if elements + 1 >= merge_from else self.seen.appendValue(element)

        def close(self):
            pass

    return Guard()


#: Buckets of the guard's state. Fixed for the life of a checkpoint: it says where an id's state is.
GUARD_BUCKETS = 1 << 16


def guarded(requests: DataFrame) -> DataFrame:
    """A request stream without repeats: ``(request_id, rejected, body, conflict)``, at most one row without and one with a
    conflict per id over the stream's life. ``body`` is the request as JSON.

    Rows with a ``reason`` (of ``requests.posting_requests``) come once per distinct ``line``: ``rejected`` is the line's
    SHA-256 and ``body`` a JSON object of request id, reason and line."""
    body = F.to_json(F.struct(*[c for c, _, _ in schemas.REQUESTS if c != "request_id"]), _TIMES)
    if "reason" in requests.columns:
        bad = F.col("reason").isNotNull()
        letter = F.to_json(F.struct("request_id", "reason", "line"))
        rows = requests.select(F.when(~bad, F.col("request_id")).alias("request_id"),
                               F.when(bad, F.sha2("line", 256)).alias("rejected"), F.when(bad, letter).otherwise(body).alias("body"))
    else:
        rows = requests.select("request_id", F.lit(None).cast("string").alias("rejected"), body.alias("body"))
    bucket = F.pmod(F.xxhash64("request_id", "rejected"), F.lit(GUARD_BUCKETS))
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithState(
        _guard(), "request_id bigint, rejected string, body string, conflict boolean", "append", "none")


def stream_posting(spark: SparkSession, source_dir: str, store_root: str, checkpoint_location: str,
                   as_of: str, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``. The store must hold a
    committed batch (``store.init_store``)."""
    reader = spark.readStream.schema(schemas.struct(schemas.REQUESTS))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return post_stream(guarded(reader.parquet(source_dir)), store_root, checkpoint_location, as_of)


def stream_bodies(spark: SparkSession, source_dir: str, store_root: str, checkpoint_location: str,
                  as_of: str, max_files_per_trigger: int | None = None):
    """Start the stream on text files of request envelopes, one JSON object a line. Whole lines are read, also broken ones;
    results and dead letters of a micro-batch appear together or not at all."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return post_stream(guarded(posting_requests(reader.text(source_dir))), store_root, checkpoint_location, as_of)


def post_stream(stream: DataFrame, store_root: str, checkpoint_location: str, as_of: str):
    """Post the rows of :func:`guarded`, a micro-batch at a time."""
    spark = stream.sparkSession
    body_type = T.StructType([f for f in schemas.struct(schemas.REQUESTS) if f.name != "request_id"])

    def post_batch(batch: DataFrame, epoch_id: int) -> None:
        s = batch.sparkSession
        # the state is stepped once, whatever reads the batch, and also where the batch is known
        batch = freeze(batch, "ledgerline-stream")
        marks, last_epoch = S.last_commit(s, store_root)
        if (last_epoch is None or epoch_id > last_epoch) and not batch.isEmpty():
            rejected = batch.where("rejected IS NOT NULL").select(F.from_json("body", REJECT_SCHEMA).alias("r")).select("r.*")
            rows = batch.where("rejected IS NULL").select("request_id", F.from_json("body", body_type, _TIMES).alias("body"), "conflict")
            rows = rows.select("request_id", "body.*", "conflict")
            out = P.post(rows.where(~F.col("conflict")), S.read_store(s, store_root), as_of, marks=marks)
            refused = rows.where("conflict").select(
                "request_id", "op", F.lit(False).alias("accepted"), F.lit(P.DUPLICATE).alias("reason"),
                F.lit(None).cast(schemas.MONEY).alias("new_balance"), F.lit(None).cast("bigint").alias("transaction_id"),
            )
            S.apply_updates(store_root, out, as_of, epoch=epoch_id,
                            extra={RESULTS: out.results.unionByName(refused), REJECTS: rejected})
        discard(batch)

    with rocksdb_state(spark):
        return (
            stream.writeStream.foreachBatch(post_batch)
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True)
            .start()
        )


def posted_results(spark: SparkSession, store_root: str) -> DataFrame:
    return S.read_batch_rows(spark, store_root, RESULTS, RESULT_SCHEMA).drop("batch")


def rejected_lines(spark: SparkSession, store_root: str) -> DataFrame | None:
    """The committed dead letters: the request id (where one could be read), the reason and the line as it was sent."""
    rows = S.read_batch_rows(spark, store_root, REJECTS, REJECT_SCHEMA)
    return None if rows is None else rows.drop("batch")
