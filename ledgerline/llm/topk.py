"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are integers (floats are scaled and floored). Candidates are dealt into
buckets of similar length, longest first. A query's k-th best score so far is its
threshold; in a bucket whose longest vector is ``l`` only directions whose cosine with
the query reaches ``threshold / (|q| l)`` can enter the result:

* above 1, the whole bucket is skipped (length pruning), and within a bucket so are
  the vectors shorter than ``threshold / |q|``;
* where that cosine is high, coordinate pruning keeps the vectors whose coordinate
  along the query's largest one lies in the interval that it allows;
* the rest are verified by their exact inner products.

First thresholds come from each query's best scores in the longest bucket. Buckets meet
query blocks in a join on the bucket's number, so a task holds one bucket of at most
``bucket_rows`` vectors and one block of at most ``block_rows`` queries at a time.

Vectors that are null or hold null or non-finite components take no part; an
empty vector scores 0 with others of its kind. Vectors of different dimensions are
matched as if the shorter ended in zeros. Repeated ids are separate rows: a query's own row is
no candidate of it, another row with its id is one. Products must fit 64 bits, as the
score's type does; a best score beyond them fails the query rather than give a wrong one.
Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
#: Cosines below this make coordinate intervals too wide to be worth a look.
COORDINATE_FROM = 0.6


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id, v array<bigint>, norm double`` of the vectors that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), x.alias("x")).where("id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    v = F.transform("x", lambda e: F.floor(e * F.lit(float(scale))).cast("bigint"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))
    return rows.select("id", v.alias("v")).select("id", "v", norm.alias("norm"))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), max([1, *map(len, rows)])), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _bytes(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the narrowest type that holds it."""
    largest = int(np.abs(m).max(initial=0))
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    return kind, m.astype(kind).tobytes()


def _of(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).astype(np.int64)


class Bucket:
    """Vectors sorted from the longest to the shortest."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.matrix, self.norms, self.places = ids[order], matrix[order], norms[order], order
        self.floats = self.matrix.astype(np.float64)
        self.unit = self.floats / np.maximum(self.norms, 1e-300)[:, None]
        self.largest = int(np.abs(matrix).max(initial=0))

    def products(self, q: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Exact integer inner products, through floats where they can hold them."""
        bound = self.largest * int(np.abs(q).max(initial=0)) * max(1, len(q))
        if bound < 1 << 53:
            return (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.matrix[rows] @ q
        return (self.matrix[rows].astype(object) @ q.astype(object)).astype(object)

    def search(self, own: int, q: np.ndarray, k: int, threshold: float) -> list[tuple[int, int]]:
        """The best ``k`` of this bucket that score ``threshold`` at least: (score, id).
        ``own``: the query's place in the bucket, or -1."""
        if not len(self.ids):
            return []
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        n = len(self.ids)
        if threshold > 0 and length > 0:
            slack = 1 - 1e-9  # for rounding: prune a little less
            if length * self.norms[0] < threshold * slack:
                return []
            n = int(np.searchsorted(-self.norms, -(threshold * slack / length), "right"))
            cosine = threshold * slack / (length * self.norms[0])
            if cosine >= COORDINATE_FROM:
                f = int(np.argmax(np.abs(q)))
                c, t = float(q[f]) / length, min(1.0, cosine)
                wide = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c))) + 1e-9
                # where the cap around the query holds the axis itself, every larger value fits too
                low = -np.inf if -c >= t else c * t - wide
                high = np.inf if c >= t else c * t + wide
                x = self.unit[:n, f]
                rows = np.flatnonzero((x >= low) & (x <= high))
            else:
                rows = np.arange(n)
        else:
            rows = np.arange(n)
        rows = rows[self.places[rows] != own]
        if not len(rows):
            return []
        scores = self.products(q, rows)
        if len(rows) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]
            keep = np.flatnonzero(scores >= cut)
            rows, scores = rows[keep], scores[keep]
        best = sorted(zip((-int(s) for s in scores), self.ids[rows].tolist(), strict=True))[:k]
        return [(-s, i) for s, i in best if -s >= threshold]


def _bundled(batches: Iterator[pa.RecordBatch], size: int, row) -> Iterator[pa.RecordBatch]:
    """Runs of ``size`` input rows, each made one output row by ``row(number, columns)``."""
    held: list[list] = []
    number = 0
    for batch in batches:
        held += [list(x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        while len(held) >= size:
            yield row(number, list(zip(*held[:size], strict=True)))
            held, number = held[size:], number + 1
    if held:
        yield row(number, list(zip(*held, strict=True)))


_BUCKET = "part int, bucket bigint, width int, kind string, ids binary, m binary"
_BLOCK = "block bigint, width int, kind string, ids binary, at binary, m binary"


def _one_row(schema: str, *values: object) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _buckets(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """The vectors by falling length, ``size`` to a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def row(number: int, columns: list) -> pa.RecordBatch:
            m = _matrix(columns[1])
            return _one_row(_BUCKET, part, (part << 24) + number, m.shape[1], *_kinded(columns[0], m))

        yield from _bundled(batches, size, row)

    dealt = rows.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"))
    return dealt.select("id", "v").mapInArrow(run, _BUCKET)


def _kinded(ids: tuple, m: np.ndarray) -> tuple[str, bytes, bytes]:
    kind, data = _bytes(m)
    return kind, np.asarray(ids, "<i8").tobytes(), data


def _queries(buckets: DataFrame, every: int, blocks: int, size: int) -> DataFrame:
    """The buckets' queries, gathered in blocks of ``size``; ``at``: bucket and place of each."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, m = np.frombuffer(r["ids"], "<i8"), _of(r["kind"], r["m"], r["width"])
                rows = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), r["bucket"])), pa.array(rows), pa.array(m[rows].tolist(), pa.list_(pa.int64()))], names=["id", "bucket", "place", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def row(number: int, columns: list) -> pa.RecordBatch:
            m = _matrix(columns[3])
            kind, ids, data = _kinded(columns[0], m)
            at = np.asarray([columns[1], columns[2]], "<i8").tobytes()
            return _one_row(_BLOCK, (task << 24) + number, m.shape[1], kind, ids, at, data)

        yield from _bundled(batches, size, row)

    picked = buckets.mapInArrow(pick, "id bigint, bucket bigint, place bigint, v array<bigint>")
    return picked.repartition(blocks, "bucket", "place").mapInArrow(run, _BLOCK)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """``block, nth, query_id, score, id``: each query's best of each bucket. A row of
    ``pairs`` holds a block, its thresholds (or null) and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != number:
                    number, bucket = r["bucket"], Bucket(np.frombuffer(r["ids"], "<i8"), _of(r["kind"], r["m"], r["width"]))
                queries, ids = _of(r["q_kind"], r["q_m"], r["q_width"]), np.frombuffer(r["q_ids"], "<i8")
                floors = np.frombuffer(r["floors"], "<f8") if r["floors"] is not None else np.full(len(ids), -np.inf)
                at = np.frombuffer(r["at"], "<i8").reshape(2, -1)
                width = bucket.matrix.shape[1]
                queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
                out: list[tuple] = []
                for n, q in enumerate(queries):
                    own = int(at[1, n]) if at[0, n] == number else -1
                    out += [(r["block"], n, int(ids[n]), s, i) for s, i in bucket.search(own, q, k, float(floors[n]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["block", "nth", "query_id", "score", "id"])

    return pairs.mapInArrow(run, "block bigint, nth int, query_id bigint, score bigint, id bigint")


def _floors(found: DataFrame, k: int) -> DataFrame:
    """``block, floors``: a query's ``k``-th best score, minus infinity where it has fewer."""
    each = found.groupBy("block", "nth").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("low"))
    listed = each.groupBy("block").agg(F.collect_list(F.struct("nth", "low")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                floors = np.full(max(x["nth"] for x in r["x"]) + 1, -np.inf)
                for x in r["x"]:
                    floors[x["nth"]] = x["low"]
                yield _one_row("block bigint, floors binary", r["block"], floors.astype("<f8").tobytes())

    return listed.mapInArrow(run, "block bigint, floors binary")


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, every: int = 100,
    scale: int = SCALE, bucket_rows: int = 2048, block_rows: int = 512,
) -> DataFrame:
    """``query_id, rank, id, score``: for each vector whose id is divisible by ``every`` the
    ``k`` others of the largest inner product, ties to the smaller id."""
    spark = common.prepare(vectors.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")  # a row holds a bucket and a block
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    parts, n_blocks = max(1, -(-counted["n"] // bucket_rows)), max(1, -(-counted["q"] // block_rows))
    buckets = common.materialize(_buckets(rows, parts, bucket_rows), "buckets")
    blocks = common.materialize(_queries(buckets, every, n_blocks, block_rows), "queries")
    parts = buckets.agg(F.max("part")).first()[0]
    blocks = blocks.select("block", "at", *(F.col(c).alias(f"q_{c}") for c in ("width", "kind", "ids", "m")))

    first = blocks.withColumns({"part": F.lit(0), "floors": F.lit(None).cast("binary")})
    first = first.join(buckets.where(F.col("bucket") == 0), "part")
    floors = _floors(_search(first, k), k)
    spread = blocks.join(floors, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts or 0))))
    pairs = spread.join(buckets, "part").repartition(max(1, (parts or 0) + 1) * n_blocks, "bucket", "block")
    found = _search(pairs, k)
    best = Window.partitionBy("block", "nth").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
