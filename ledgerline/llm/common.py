"""Helpers shared by the corpus operators: intermediate tables, workers' import
path, word hashing and connected components."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of an Arrow batch sent to Python: texts may be long, so batches stay small.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the Python stages: the workers find this package, and
    an Arrow batch holds few rows, since a text has no length limit."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts
    the lineage, and a lost executor costs only the tasks that read it."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column_kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


# --- hashing of words and n-grams (64 bits) --------------------------------------

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def hash_ngrams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive words."""
    size = len(word_hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(size, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = mix(out * _MUL[0] + word_hashes[i : i + size])
    return out


# --- connected components -------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an undirected edge list: ``(node, component)`` with
    the smallest node of each component, for every node that has an edge.

    Each round hooks every node to its smallest neighbour, follows the pointers
    until they are stable, and contracts the edges, so the graph shrinks
    geometrically. Only counts reach the driver; a node with many edges is met
    by partial aggregates and by joins that AQE can split.
    """
    cols = F.col(a).alias("a"), F.col(b).alias("b")
    work = materialize(edges.select(*cols).where("a <> b").distinct(), f"{name}-edges")
    nodes = work.select(F.col("a").alias("node")).union(work.select("b")).distinct()
    labels = materialize(nodes.withColumn("component", F.col("node")), f"{name}-labels")
    while not work.isEmpty():
        both = work.select("a", "b").union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = materialize(parent.select("node", F.least("node", "low").alias("up")), f"{name}-parent")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(parent.join(above, "up").select("node", "up", "top"), f"{name}-jump")
            done = jumped.where("up <> top").isEmpty()
            parent = jumped.select("node", F.col("top").alias("up"))
            if done:
                break
        up = parent.select(F.col("node").alias("component"), "up")
        labels = materialize(
            labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
            f"{name}-labels",
        )
        for end in ("a", "b"):
            work = work.join(parent.select(F.col("node").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)
        work = materialize(work.where("a <> b").distinct(), f"{name}-edges")
    return labels




# --- Columns of the input whose names an operator needs ----------------------------


def spare(columns: list[str], name: str) -> str:
    """``name``, with as many underscores added as no column bears it (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(columns: list[str], names: list[str]) -> list[str]:
    """The columns that bear none of the names (case ignored)."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def set_aside(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """``rows`` with the columns that bear one of the names renamed, and the expressions that
    give all its columns their own names back."""
    held, back = [], []
    for c in rows.columns:
        if not others([c], names):
            new = spare([*rows.columns, *names, *held], f"{c}_")
            held.append(new)
            rows = rows.withColumnRenamed(c, new)
            back.append(F.col(f"`{new}`").alias(c))
        else:
            back.append(F.col(f"`{c}`"))
    return rows, back


# --- Bloom filters: fewer rows shuffled before an exact join ---------------------


class Bloom:
    """A set of 64-bit integers with false positives; used only before a join that is
    exact, so its size bounds memory and not the result."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, dtype=np.uint8) if data is None else data

    def _places(self, values: np.ndarray) -> list[np.ndarray]:
        h = mix(values.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        mask = np.uint64(self.bits - 1)
        return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]

    def add(self, values: np.ndarray) -> None:
        for at in self._places(values):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def __contains__(self, value: int) -> bool:
        return bool(self.test(np.asarray([value], dtype=np.int64))[0])

    def test(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), dtype=bool)
        for at in self._places(values):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


#: Largest Bloom filter: 2^27 bits are 16 MB.
BLOOM_BITS = 1 << 27


def bloom(df: DataFrame, column: str, count: int, tasks: int = 6):
    """A broadcast Bloom filter of a bigint column: 16 bits a value and at most
    ``BLOOM_BITS``. The ``tasks`` partial filters are the only data that reach the driver."""
    import pyarrow as pa

    bits = 1 << 13
    while bits < min(16 * count, BLOOM_BITS):
        bits *= 2

    def run(batches):
        part = Bloom(bits)
        for batch in batches:
            part.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([part.data.tobytes()], pa.binary())], names=["data"])

    whole = np.zeros(bits // 8, dtype=np.uint8)
    # written first, since a local iterator runs one task after the other
    for row in materialize(df.select(F.col(column).cast("bigint")).coalesce(tasks).mapInArrow(run, "data binary"), "bloom").toLocalIterator():
        whole |= np.frombuffer(row["data"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(Bloom(bits, whole))


def without_ids(rows: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows whose bigint id is not in ``gone`` (one column, distinct). Rows that a Bloom
    filter of ``gone`` holds back meet an exact anti join; the others are not shuffled."""
    import pyarrow as pa

    name = gone.columns[0]
    member = bloom(gone, name, gone.count())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def only(maybe: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column(batch.num_columns - 1)
                found = member.value.test(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~np.asarray(ids.is_null())
                kept = batch.filter(pa.array(found == maybe))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

        return rows.select("*", F.col(f"`{id_col}`").cast("bigint").alias(spare(rows.columns, "__id"))).mapInArrow(run, kinds)

    held, key = only(True), f"gone_{uuid.uuid4().hex}"  # no column of the rows bears this name
    held = held.join(gone.select(F.col(name).alias(key)), F.col(f"`{id_col}`").cast("bigint") == F.col(key), "left_anti")
    return only(False).unionByName(held)
