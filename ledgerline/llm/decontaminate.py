"""Benchmark decontamination by winnowing.

Words are hashed, ``k`` consecutive words make a k-gram hash, and of each run of
``w`` consecutive k-grams the smallest hash (the last, in a tie) is a fingerprint.
Two texts that share ``k + w - 1`` consecutive words share a fingerprint of that
span, since the same run has the same smallest hash in both. With
``w = span - k + 1`` no shared span of ``span`` words is missed.

Benchmark windows (``span`` consecutive words; an item with fewer is one window) are
fingerprinted by the same rule, for each window length that occurs. A document's
fingerprints are joined with them, and every match is extended to the windows
around it, whose words are compared in full.

The benchmark index goes to the tasks in blocks of at most ``block_words`` words. As a
rule there is one block; more are read in turn, each with a pass over the documents
whose hits are then merged by text. Nothing of the documents is shuffled with
one block.

Null texts have no words. An item with a null id marks its hits and counts as the
item ``null``. Repeated items count once; repeated documents give a row each.
Documents without words: no hit, not contaminated. Empty tables give no rows or
no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of benchmark text that one block of the index may hold (about 100 bytes each).
BLOCK_WORDS = 2_000_000
SPAN = 13
#: Words of a k-gram; shorter windows than this are looked up whole.
K = 6

#: A-Z become a-z; ASCII characters other than digits and letters separate words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the fingerprints: for each run of ``w`` hashes its smallest, the
    last one in a tie. Fewer than ``w`` hashes have none."""
    if len(grams) < w:
        return np.empty(0, dtype=np.int64)
    if w == 1:
        return np.arange(len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    last = w - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(last + np.arange(len(view)))


class Index:
    """Windows of benchmark items, by length and fingerprint."""

    def __init__(self, items: list[tuple[object, list[bytes]]], span: int = SPAN, k: int = K):
        self.span = span
        windows: dict[int, dict[bytes, set]] = {}
        for item, words in items:
            size = min(span, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                windows.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add(item)
        #: By window length: words of a k-gram, run length, sorted fingerprints, sorted window hashes, windows.
        self.by_size = {}
        for size, texts in windows.items():
            gram, hashes, prints = min(k, size), {}, set()
            for text, ids in texts.items():
                h = common.hash_words(text.split(b" "))
                hashes.setdefault(int(common.hash_ngrams(h, size)[0]), {})[text] = ids
                grams = common.hash_ngrams(h, gram)
                prints.update(grams[winnow(grams, size - gram + 1)].tolist())
            self.by_size[size] = (gram, size - gram + 1, np.sort(np.fromiter(prints, np.uint64, len(prints))), np.sort(np.fromiter(hashes, np.uint64, len(hashes))), hashes)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Flags of the hit words, and the items whose windows occur."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        h = common.hash_words(words)
        grams: dict[int, np.ndarray] = {}
        for size, (gram, run, prints, window_hashes, windows) in self.by_size.items():
            if len(words) < size:
                continue
            if gram not in grams:
                grams[gram] = common.hash_ngrams(h, gram)
            at = winnow(grams[gram], run)
            at = at[_isin(grams[gram][at], prints)]
            if not len(at):
                continue
            # a fingerprint at p lies in the windows that start at p - run + 1 to p
            starts = np.unique((at[:, None] - np.arange(run)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + size <= len(words))]
            of_window = np.array([common.hash_ngrams(h[s : s + size], size)[0] for s in starts], dtype=np.uint64) if len(starts) < 8 else common.hash_ngrams(h, size)[starts]
            ok = _isin(of_window, window_hashes) if len(starts) else np.empty(0, bool)
            for s, key in zip(starts[ok].tolist(), of_window[ok].tolist(), strict=True):
                ids = windows[key].get(b" ".join(words[s : s + size]))
                if ids is not None:
                    hit[s : s + size] = True
                    found |= ids
        return hit, found


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _blocks(spark, bench: DataFrame, item_col: str, text_col: str, block_words: int) -> list[list[tuple]]:
    """The items in blocks. One partition is fetched at a time."""
    blocks: list[list[tuple]] = [[]]
    held = 0
    rows = bench.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if held and held + len(words) > block_words:
            blocks.append([])
            held = 0
        blocks[-1].append((row["i"], words))
        held += len(words)
    return blocks


#: The columns that :func:`decontaminate` adds.
ADDED = ["n_words", "n_hit", "items", "spans", "contaminated"]


def decontaminate(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", span: int = SPAN, k: int = K, per_hit: int = 20, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Adds ``n_words, n_hit, items (sorted strings), spans (start, end of each run of hit
    words), contaminated`` to the columns of ``docs`` (whose own of these names, case ignored, go):
    contaminated if some word is hit and ``per_hit`` times the hits reach the words."""
    spark = common.prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c in (id_col, text_col) or common.others([c], ADDED)]
    frames = []
    blocks = _blocks(spark, bench, item_col, item_text_col, block_words)
    for block in blocks:
        held = spark.sparkContext.broadcast(block)  # at most block_words words

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, span, k)
            for batch in batches:
                n, n_hit, items, spans = [], [], [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    words = words_of(text)
                    hit, found = index.hits(words)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    n.append(len(words))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted("null" if x is None else x for x in found))
                    spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                bad = [h > 0 and per_hit * h >= m for h, m in zip(n_hit, n, strict=True)]
                columns = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(bad, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *ADDED])

        own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
        read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(common.spare(kept, "__text")))
        frames.append(read.mapInArrow(scan, f"{own}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>, contaminated boolean"))
    return frames[0] if len(frames) == 1 else _merged(docs, kept, text_col, frames, per_hit)


def _merged(docs: DataFrame, kept: list[str], text_col: str, frames: list[DataFrame], per_hit: int) -> DataFrame:
    """The blocks' hits of each distinct text, put together and joined to its rows."""
    name = common.spare([*kept, *ADDED], "__key")
    key = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias(name)
    one = [f.select(key, "n_words", "items", F.col("spans")).dropDuplicates([name]) for f in frames]
    every = reduce(DataFrame.unionByName, one).groupBy(name).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )

    def join(acc, x):
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    spans = F.aggregate("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), join)
    every = every.withColumn("spans", spans)
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    every = every.withColumn("n_hit", hits).withColumn("contaminated", (F.col("n_hit") > 0) & (per_hit * F.col("n_hit") >= F.col("n_words")))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], key).join(every, name)
    return rows.select(*[F.col(f"`{c}`") for c in kept], "n_words", "n_hit", "items", "spans", "contaminated")


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)
