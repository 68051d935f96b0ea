"""The trie of conversation prefixes, from range minima over sorted longest common prefixes.

A conversation is its turns in order; a node is a distinct sequence of a conversation's first d turns, its members
are the conversations that start with it. Each turn is a digest of role and text, so texts are read once and
never shuffled.

1. Conversations with equal turns are one *sequence* with a count, the smallest id and the hash of all ids. Ids are
   hashed in their order from pieces that sorted ranges of ids make, so no group is held whole.
2. Distinct sequences are sorted and cut into ranges ("chunks") of a bounded number of turns.
3. A chunk's task holds the longest common prefixes (LCPs) of neighbours and a sparse table of their range minima.
   Each candidate (sequence, depth) searches its left and right extents on its own by halving steps in the table:
   the neighbours whose minimum reaches the depth. A candidate that is its own left extent is a node, and the
   extents are its members; counts, leaves, children and saved tokens are differences of prefix sums. No stack is kept.
4. Only nodes on the path that two chunks share at their border are incomplete. Their parts are sums and minima, so one
   aggregate by prefix completes them. There are at most (depth x borders) of these.

Defined results: rows without a conversation id take no part; a null role or text is empty; turns are ordered by turn
(null first), then by their digests; an empty table has no node, not even the root. Extra columns are not read. A
conversation's digests (not its texts) lie in one row, so they must fit a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Hex digits of a turn's digest (128 bits of SHA-256).
DIGEST = 32
#: Turns of a chunk, and ids of a hashed piece.
CHUNK_TURNS, PIECE = 300_000, 8192
#: Border nodes up to this number are sent to all tasks to name their children's parents.
BORDER_ROWS = 100_000
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv bigint, turns array<struct<turn, digest, chars>>)``: each conversation's turns in order."""
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, DIGEST)
    rows = turns.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"),
        F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.length(said).alias("chars")).alias("said"),
    )
    return rows.where("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """``(sid, ends)``: the SHA-256 of each sequence's conversation ids, ascending and joined by commas."""

    def pack(batches):
        last, ids = None, []
        for batch in batches:
            sid, conv = batch.column("sid").to_pylist(), batch.column("conv").to_pylist()
            out = []
            for s, c in zip(sid, conv):
                if ids and (s != last or len(ids) == PIECE):
                    out.append((last, ids[0], ",".join(map(str, ids)).encode()))
                    ids = []
                last = s
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["sid", "first", "piece"])
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([last]), pa.array([ids[0]]), pa.array([",".join(map(str, ids)).encode()])], names=["sid", "first", "piece"]
            )

    def digest(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for s, piece in zip(batch.column("sid").to_pylist(), batch.column("piece").to_pylist()):
                if s != last:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = s, hashlib.sha256(piece)
                else:
                    state.update(b"," + piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["sid", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], names=["sid", "ends"])

    pieces = rows.repartitionByRange("sid", "conv").sortWithinPartitions("sid", "conv")
    pieces = pieces.mapInArrow(pack, "sid string, first bigint, piece binary")
    return pieces.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(digest, "sid string, ends string")


def _range_minima(x: np.ndarray) -> list[np.ndarray]:
    """The sparse table: level k holds the minimum of the 2^k values from each place on."""
    table = [x]
    while 2 << (len(table) - 1) <= len(x):
        span = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
    return table


def left_extent(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row whose common prefix with ``row`` reaches ``depth``; the table is over each row's LCP with the one before."""
    at = row.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        low = table[k][np.maximum(at - step + 1, 0).clip(max=len(table[k]) - 1)]
        at -= np.where((at - step >= 0) & (low >= depth), step, 0)
    return at


def right_extent(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row whose common prefix with ``row`` reaches ``depth``."""
    at, n = row.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        low = table[k][(at + 1).clip(max=len(table[k]) - 1)]
        at += np.where((at + step < n) & (low >= depth), step, 0)
    return at


def _least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The minimum of rows ``left..right``."""
    k = np.frexp((right - left + 1).astype(float))[1] - 1
    out = np.empty(len(left), np.int64)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(table[level][left[at]], table[level][right[at] - (1 << int(level)) + 1])
    return out


def common_prefixes(token: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of tokens that each sequence shares with the one before it (0 for the first)."""
    n = len(start)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    both = np.minimum(size[1:], size[:-1])
    owner = np.repeat(np.arange(n - 1), both)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(both) - both, both)
    same = (token[start[1:][owner] + number] == token[start[:-1][owner] + number]).all(axis=1)
    out[1:] = both
    np.minimum.at(out, owner[~same] + 1, number[~same])
    return out


NODE = (
    "depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends string, own string, parent string"
)


def _paths(seq: bytes, deepest: int) -> list[str]:
    """Names of the prefixes of a sequence up to a depth."""
    out, state = [], hashlib.sha256()
    for d in range(deepest + 1):
        if d:
            state.update(seq[(d - 1) * DIGEST : d * DIGEST])
        out.append(state.hexdigest())
    return out


def chunk_nodes(chunk: pa.Table, before: int, after: int) -> pa.RecordBatch:
    """The nodes of sorted distinct sequences ``(seq, n, low, chars, ends)``. ``before`` and ``after`` are the prefixes shared
    with the sequences around the chunk (-1 without any). A node shared with a neighbour bears its name in ``own``
    and counts this chunk's part; a node whose parent is such a node bears its name in ``parent``."""
    seq = chunk.column("seq").combine_chunks().cast(pa.large_string())
    ends = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    raw = seq.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)
    token = np.ascontiguousarray(flat).reshape(-1, DIGEST).view(np.uint64)
    start = (ends[:-1] - ends[0]) // DIGEST
    size = np.diff(ends) // DIGEST
    n = len(size)
    count, low = chunk.column("n").to_numpy(), chunk.column("low").to_numpy()
    chars = chunk.column("chars").combine_chunks().flatten().to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(chars)])  # characters of a sequence's first k turns: total[start + k] - total[start]
    lcp = common_prefixes(token, start, size)
    lcp[0] = before

    def spoken(row, depth):
        return total[start[row] + np.maximum(depth, 0)] - total[start[row]]

    table, lows = _range_minima(lcp), _range_minima(low)
    rows = np.arange(n)
    following = np.append(lcp[1:], after)
    sums = {
        "n": count, "leaves": (following < size).astype(np.int64),
        "spoken": count * spoken(rows, size), "kept": spoken(rows, size) - spoken(rows, lcp),
    }
    sums = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in sums.items()}

    row = np.repeat(rows, size + 1)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    left = left_extent(table, row, depth)
    own = left == row
    row, depth = row[own], depth[own]
    right = right_extent(table, row, depth)

    def between(name, a, b):
        return sums[name][b + 1] - sums[name][a]

    joined = (row == 0) & (depth <= before)  # the node goes on in the chunk before
    open_ = joined | ((right == n - 1) & (depth <= after))
    n_convs = between("n", row, right)
    # a child starts at the node's first row, if that is longer, and wherever the LCP is the depth
    at = np.sort(lcp * n + rows)
    first = row + np.where(joined, 0, 1)
    n_children = np.searchsorted(at, depth * n + right, side="right") - np.searchsorted(at, depth * n + first)
    n_children += ~joined & (size[row] > depth)
    kept = between("kept", row, right)
    kept = np.where(joined, kept, kept + spoken(row, lcp[row]) - spoken(row, depth - 1))
    saved = between("spoken", row, right) - n_convs * spoken(row, depth - 1) - kept

    p_left = left_extent(table, row, depth - 1)
    p_right = right_extent(table, row, depth - 1)
    p_before = (p_left == 0) & (depth - 1 <= before)
    p_open = (depth > 0) & (p_before | ((p_right == n - 1) & (depth - 1 <= after)))
    parent_low = _least(lows, p_left, p_right)

    paths = _paths(seq[0].as_py().encode(), before), _paths(seq[n - 1].as_py().encode(), after)

    def names(which, in_first, depths):
        out = np.full(len(which), None, object)
        for k in np.flatnonzero(which).tolist():
            out[k] = paths[0 if in_first[k] else 1][depths[k]]
        return pa.array(out, pa.string())

    ended = ~joined & (size[row] == depth)
    hashes = chunk.column("ends").combine_chunks().take(pa.array(row))
    hashes = pa.compute.if_else(pa.array(ended), hashes, pa.scalar(None, pa.string()))
    none = pa.scalar(None, pa.int64())
    parent = pa.compute.if_else(pa.array((depth > 0) & ~p_open), pa.array(parent_low), none)
    return pa.RecordBatch.from_arrays(
        [pa.array(depth), pa.array(_least(lows, row, right)), parent, pa.array(n_convs), pa.array(n_children), pa.array(between("leaves", row, right)),
         pa.array(saved), hashes, names(open_, joined, depth), names(p_open, p_before, depth - 1)],
        names=["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "own", "parent"],
    )


def _borders(chunked: DataFrame) -> dict[int, tuple[int, int]]:
    """Each chunk's shared prefixes with its neighbours: two numbers a chunk reach the driver."""
    ends = chunked.groupBy("chunk").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    order = Window.orderBy("chunk")  # one row a chunk
    ends = ends.select("chunk", "first", F.lag("last").over(order).alias("prior"))

    def run(batches):
        for batch in batches:
            shared = []
            for a, b in zip(batch.column("first").to_pylist(), batch.column("prior").to_pylist()):
                if b is None:
                    shared.append(-1)
                    continue
                k, most = 0, min(len(a), len(b))
                while k < most and a[k : k + DIGEST] == b[k : k + DIGEST]:
                    k += DIGEST
                shared.append(k // DIGEST)
            yield pa.RecordBatch.from_arrays([batch.column("chunk").cast(pa.int64()), pa.array(shared, pa.int64())], names=["chunk", "shared"])

    rows = sorted((r["chunk"], r["shared"]) for r in ends.mapInArrow(run, "chunk bigint, shared bigint").collect())
    shared = [s for _, s in rows] + [-1]
    return {chunk: (shared[k], shared[k + 1]) for k, (chunk, _) in enumerate(rows)}


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``(conv bigint, turns array<struct<digest, chars, ..>>)``: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (over the subtree, (n_convs - 1) x characters of a node's last text) and ``ends_sha256`` (of the ids of the
    members without further turns)."""
    spark = common.prepare(convs.sparkSession)
    rows = convs.select("conv", F.array_join("turns.digest", "").alias("seq"), F.col("turns.chars").alias("chars"))
    rows = common.materialize(rows.withColumn("sid", F.sha2("seq", 256)), "conversations")
    ends = _ends(rows.select("sid", "conv"))
    distinct = rows.groupBy("sid").agg(
        F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv").alias("low"),
    )
    distinct = common.materialize(distinct.join(ends, "sid").drop("sid"), "sequences")
    turns = distinct.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    chunks = max(1, -(-turns // CHUNK_TURNS))
    chunked = distinct.repartitionByRange(chunks, "seq").withColumn("chunk", F.spark_partition_id())
    chunked = common.materialize(chunked, "sorted-sequences")
    borders = spark.sparkContext.broadcast(_borders(chunked))

    def run(batches):
        held = []

        def flush():
            return chunk_nodes(pa.Table.from_batches(held), *borders.value[held[0].column("chunk")[0].as_py()])

        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column("chunk")[0].as_py() != chunk[a]:
                    yield flush()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    found = chunked.repartition("chunk").sortWithinPartitions("chunk", "seq").mapInArrow(run, NODE)
    found = common.materialize(found, "trie-parts")
    total = [F.sum(c).cast("bigint").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = found.where("own IS NOT NULL").groupBy("own").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *total, F.max("ends").alias("ends"), F.max("parent").alias("parent"),
    )
    border = common.materialize(border, "border-nodes")
    above = border.select(F.col("own").alias("parent"), F.col("conv_id").alias("above"))
    if border.count() <= BORDER_ROWS:
        above = F.broadcast(above)
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "parent"]
    nodes = found.where("own IS NULL").select(columns)
    nodes = nodes.unionByName(border.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(columns))
    nodes = nodes.join(above, "parent", "left")
    return nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
