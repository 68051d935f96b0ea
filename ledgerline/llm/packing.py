"""Best-fit packing of tokenised documents into sequences: minimum bin slack.

1. Every document becomes token ids plus an end id; one longer than a sequence is
   cut into full pieces, of which only the first is shorter.
2. Pieces are counted by length. There are at most ``capacity`` lengths, so the
   histogram, and with it the search, is bounded whatever the corpus' size.
3. Minimum bin slack on the histogram: a bin takes the longest length left, and a
   bitset subset-sum dynamic program over the available lengths (with their
   counts) finds the fullest feasible rest. That combination is removed as often
   as the counts allow. Each step takes a length below ``capacity / length``
   copies or lowers one that is, so there are O(capacity log capacity) steps.
4. Pieces of one length are interchangeable: the i-th piece of a length goes to
   the i-th place the plan has for it. The rank is the piece's rank in its task
   plus the count of that length in earlier tasks.

Nulls count as empty texts (one end id). Repeated rows are packed once each. An
empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of token ids that a worker keeps for repeated lines.
CACHE_BYTES = 48 << 20
_LINES = re.compile(r"(?<=\S)(?=\n)")


class Encoder:
    """Texts to little-endian 32-bit ids of a byte-level BPE vocabulary.

    ``vocabulary`` is the JSON file that defines the ids. Where the rank file of the
    same vocabulary is given, ordinary text goes through its faster encoder; a text
    that holds a special token's string goes through the JSON file's own. A text is
    encoded by lines, which the pattern never joins when a break follows a
    non-space; ids of repeated lines are kept up to ``CACHE_BYTES``.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        special = [x.content for x in self.slow.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def _line(self, line: str) -> bytes:
        ids = self.seen.get(line)
        if ids is None:
            ids = np.asarray(self.fast.encode_to_numpy(line, disallowed_special=()), dtype="<u4").tobytes()
            size = len(ids) + 4 * len(line) + 200
            if self.held + size > CACHE_BYTES:
                self.seen.clear()
                self.held = 0
            self.seen[line] = ids
            self.held += size
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or self.special and self.special.search(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self._line, _LINES.split(text)))


def pieces(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str, ranks: str | None = None, pattern: str | None = None,
    end_id: int = 2, capacity: int = 1024, keep_ids: bool = False,
) -> DataFrame:
    """Token pieces: ``id, piece, start, length, ids_crc32, task, nth[, ids]``. ``nth``
    counts the pieces of one length in one task, so the frame must be written
    once (:func:`common.materialize`) before it is used."""
    kind = common.column_kind(docs, id_col)
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    schema += ", ids binary" if keep_ids else ""
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, nth = Encoder(vocabulary, ranks, pattern), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + tail
                total = len(ids) // 4
                first = total % capacity or capacity
                start = 0
                for piece, end in enumerate(range(first, total + 1, capacity)):
                    part = ids[4 * start : 4 * end]
                    size = end - start
                    rows.append((doc, piece, start, size, zlib.crc32(part), task, nth[size], part)[: 8 if keep_ids else 7])
                    nth[size] += 1
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    types, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, taken at most ``counts`` times each, whose sum is the largest
    that fits in ``room``: bitset subset-sum, longest lengths preferred."""
    steps: list[tuple[int, int, int]] = []  # length, copies, sums reachable before it
    reach, full = 1, (1 << (room + 1)) - 1
    for length in sorted(counts):
        copies = min(counts[length], room // length)
        taken = 1
        while copies > 0:  # binary splitting of the copies
            n = min(taken, copies)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & full
            copies -= n
            taken *= 2
    left = reach.bit_length() - 1
    chosen: list[int] = []
    for length, n, before in reversed(steps):
        if left >= length * n and before >> (left - length * n) & 1:
            chosen += [length] * n
            left -= length * n
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Minimum bin slack: ``(bins, lengths in each)`` until no length is left."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if any(k > capacity or k < 1 for k in left):
        raise ValueError(f"a piece's length must be 1 to {capacity}")
    plan: list[tuple[int, list[int]]] = []
    while left:
        seed = max(left)
        left[seed] -= 1
        rest = fullest({k: v for k, v in left.items() if v and k <= capacity - seed}, capacity - seed)
        left[seed] += 1
        bin_ = [seed, *rest]
        used: dict[int, int] = defaultdict(int)
        for x in bin_:
            used[x] += 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, bin_))
    return plan


def _places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank of each run of places, and the run's first
    sequence, copies in a sequence and offset in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for times, lengths in plan:
        offset, at = 0, 0
        while at < len(lengths):
            length, n = lengths[at], 1
            while at + n < len(lengths) and lengths[at + n] == length:
                n += 1
            runs[length].append((used[length], first, n, offset))
            used[length] += n * times
            offset += n * length
            at += n
        first += times
    return {k: tuple(np.asarray(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def place(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the materialised frame of :func:`pieces`.
    The histogram that reaches the driver has at most ``capacity`` rows; the plan
    sent to the tasks has O(capacity log capacity) runs."""
    by_task = items.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places([(t, sorted(x, reverse=True)) for t, x in plan_bins(histogram, capacity)])
    rest = [c for c in items.columns if c not in ("task", "nth")]
    ranked = items.join(before, ["length", "task"]).select(*rest, (F.col("before") + F.col("nth")).alias("rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*rest).schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(rest.index("length")).to_numpy()
            ranks = batch.column(len(rest)).to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                start, first, copies, begin = places[int(length)]
                run = np.searchsorted(start, ranks[at], "right") - 1
                within = ranks[at] - start[run]
                sequence[at] = first[run] + within // copies[run]
                offset[at] = begin[run] + within % copies[run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, f"{kinds}, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str, ranks: str | None = None,
    pattern: str | None = None, end_id: int = 2, capacity: int = 1024, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32[, ids], sequence_id,
    offset``; ``keep_ids`` adds the piece's ids (little-endian 32-bit)."""
    common.prepare(docs.sparkSession)
    cut = pieces(docs, id_col, text_col, vocabulary, ranks, pattern, end_id, capacity, keep_ids)
    return place(common.materialize(cut, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of :func:`pack` with ``keep_ids``: ``sequence_id, length, ids``. A
    group holds at most one sequence's tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
