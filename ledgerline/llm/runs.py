"""Periodic runs of words, by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
of at least ``max(least, 2 * q)`` words that no neighbouring word extends keeping the period.

* **Grammar.** The words of a batch of texts, each text closed by a symbol of its own, are compressed in
  alternate levels (:class:`Grammar`): block compression gives each maximal block of one symbol a symbol of
  (symbol, length), pair compression splits the alphabet in two halves and gives each pair (left half, right
  half) a symbol. Equal stretches are parsed alike but for a few symbols at their ends.
* **Extensions.** The longest common extension of two positions, forwards or backwards, climbs and descends the
  levels: equal symbols are skipped whole, blocks of one symbol by their common rest, so a query takes a
  logarithmic number of steps. All queries of a batch take their steps together, and only texts with candidates
  are compressed.
* **Harmonic grid.** A run of period q holds at least ``max(q, least - q)`` consecutive words that equal the word q
  later, so one of them lies on the multiples of that step. All such candidates (n log n for n words)
  are compared by a few words, and those that agree are extended in both directions: exact runs without suffix arrays.
  The same stretch found with a multiple of its period keeps the smallest.

Each text is judged alone in the task that reads it: no shuffle, and no group of texts. Defined results: a
null text has no words; repeated rows are judged alike; input columns pass through, and ``n_words``, ``runs``
and ``kept`` replace input columns of these names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Least number of words of a run.
LEAST = 12
#: Words compressed together, and candidates compared at once; a longer text is a batch of its own.
WORDS, CANDIDATES = 100_000, 1_000_000


class Level:
    """A parse of the words: where its symbols start, and which they are."""

    def __init__(self, start: np.ndarray, symbol: np.ndarray, n: int):
        self.start, self.symbol = start, symbol
        self.index = np.full(n + 1, -1, np.int32)  # the symbol that starts at a word
        self.index[start] = np.arange(len(start), dtype=np.int32)
        self.index[n] = len(start)
        edge = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        size = np.diff(np.append(edge, len(symbol)))
        self.edge, self.size = edge, size
        first = np.repeat(edge, size)
        at = np.arange(len(symbol))
        self.before = (at - first + 1).astype(np.int32)  # symbols of the block up to and with this one
        self.after = (np.repeat(size, size) - (at - first)).astype(np.int32)  # and from this one on
        self.width = np.diff(np.append(start, n)).astype(np.int32)


class Grammar:
    """The levels of a recompression of ``words`` (small integers); ``closed`` marks the closing symbols, which no
    pair takes in."""

    def __init__(self, words: np.ndarray, closed: np.ndarray):
        n = len(words)
        self.words = words
        level = Level(np.arange(n), words.astype(np.int64), n)
        self.levels = [level]
        free, top, still = ~closed, int(words.max()) + 1 if n else 0, 0
        while still < 3 and len(level.start) > 2 * int(closed.sum()):
            symbol, start = level.symbol, level.start
            size = len(start)
            if len(level.edge) < size:  # blocks
                lone = level.size == 1
                block = np.where(lone, symbol[level.edge], -1)
                pair = np.stack([symbol[level.edge], level.size], 1)[~lone]
                block[~lone] = top + np.unique(pair, axis=0, return_inverse=True)[1].ravel()
                symbol, start, free = block, start[level.edge], free[level.edge]
                top = int(max(top, symbol.max() + 1))
                level = Level(start, symbol, n)
                self.levels.append(level)
            half = common.mix(symbol.astype(np.uint64) * np.uint64(2 * len(self.levels) + 1) + np.uint64(len(self.levels))) & np.uint64(1)
            left = half.astype(bool)
            ends = free[:-1] & free[1:]
            here, other = ends & left[:-1] & ~left[1:], ends & ~left[:-1] & left[1:]
            if other.sum() > here.sum():
                here = other
            at = np.flatnonzero(here)
            if not len(at):
                still += 1  # no such pair under this split; another may find some
                if not ends.any():
                    break
                continue
            code = symbol[at] * top + symbol[at + 1]
            symbol = symbol.copy()
            symbol[at] = top + np.unique(code, return_inverse=True)[1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            top = int(max(top, symbol[at].max() + 1))
            still = 0 if keep.sum() < 0.98 * size else still + 1
            symbol, start, free = symbol[keep], start[keep], free[keep]
            level = Level(start, symbol, n)
            self.levels.append(level)

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of positions the number of equal words from there on."""
        return self._walk(i.astype(np.int64), j.astype(np.int64), True)

    def extend_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of positions the number of equal words that end before them."""
        return self._walk(i.astype(np.int64), j.astype(np.int64), False)

    def _walk(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        top = len(self.levels) - 1

        def step(depth: int, at: np.ndarray) -> np.ndarray:
            """Skips the equal symbols that the pairs ``at`` stand before; the pairs that moved."""
            level = self.levels[depth]
            a, b = level.index[i[at]], level.index[j[at]]
            if forward:
                ok = (a >= 0) & (b >= 0) & (a < len(level.start)) & (b < len(level.start))
            else:
                ok = (a > 0) & (b > 0)
                a, b = a - 1, b - 1
            at, a, b = at[ok], a[ok], b[ok]
            same = level.symbol[a] == level.symbol[b]
            at, a, b = at[same], a[same], b[same]
            rest = np.minimum(level.after[a], level.after[b]) if forward else np.minimum(level.before[a], level.before[b])
            moved = rest.astype(np.int64) * level.width[a]
            i[at] += moved if forward else -moved
            j[at] += moved if forward else -moved
            out[at] += moved
            return at

        # up: at each level only until both positions are bounds of the next one, which takes a few symbols
        fallen, rising = [], np.arange(len(i))
        for depth in range(top):
            above = self.levels[depth + 1].index
            arrived, there = [], rising
            while len(there):
                both = (above[i[there]] >= 0) & (above[j[there]] >= 0)
                arrived.append(there[both])
                there = there[~both]
                moved = step(depth, there)
                fallen.append((depth, np.setdiff1d(there, moved, assume_unique=True)))
                there = moved
            rising = np.concatenate(arrived) if arrived else rising
        fallen.append((top, rising))
        # down: at each level until a difference
        there = np.empty(0, np.int64)
        for depth in range(top, -1, -1):
            there = np.concatenate([there, *(at for d, at in fallen if d == depth)])
            moving = there
            while len(moving):
                moving = step(depth, moving)
        return out


def _grid(n: int, least: int):
    """Candidate pairs ``(position, period)`` of a text of ``n`` words, in bounded portions."""
    q = np.arange(1, n // 2 + 1)
    q = q[np.maximum(2 * q, least) <= n]
    step = np.maximum(q, least - q)
    number = (n - q - 1) // step + 1
    done = 0
    while done < len(q):
        total = np.cumsum(number[done:])
        some = max(1, int(np.searchsorted(total, CANDIDATES, side="right")))
        part = slice(done, done + some)
        owner = np.repeat(np.arange(done, done + some), number[part])
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(number[part]) - number[part], number[part])
        yield rank * step[owner], q[owner]
        done += some


def _promising(words: np.ndarray, at: np.ndarray, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that lie in a stretch of at least ``least`` words equal to those q later; compares at most as many
    words in each direction. (Each text ends with a word of its own, so a stretch stays in its text.)"""
    same = words[at] == words[at + q]
    at, q = at[same], q[same]
    size = np.ones(len(at), np.int64)
    for way in (1, -1):
        alive = np.flatnonzero(size < least)
        for k in range(1, least):
            place = at[alive] + way * k
            fits = (place >= 0) & (place + q[alive] < len(words))
            alive, place = alive[fits], place[fits]
            alive = alive[words[place] == words[place + q[alive]]]
            if not len(alive):
                break
            size[alive] += 1
    good = size >= least
    return at[good], q[good]


def find_runs(texts: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of several word sequences: ``(text, start, length, period)``, ordered by text, start and period."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    words = np.empty(int(sizes.sum()) + len(texts), np.int64)
    closed = np.zeros(len(words), bool)
    for k, t in enumerate(texts):
        words[base[k] : base[k] + len(t)] = t
        words[base[k] + len(t)] = top + k
        closed[base[k] + len(t)] = True
    found_at, found_q = [], []
    for k, n in enumerate(sizes.tolist()):
        for at, q in _grid(n, least):
            at, q = _promising(words, at + base[k], q, (least + 1) // 2)
            found_at.append(at)
            found_q.append(q)
    none = np.empty(0, np.int64)
    at, q = np.concatenate([none, *found_at]), np.concatenate([none, *found_q])
    if not len(at):
        return none, none, none, none
    # only texts with candidates are compressed
    text = np.searchsorted(base, at, side="right") - 1
    some = np.zeros(len(texts), bool)
    some[text] = True
    taken = np.repeat(some, sizes + 1)
    shift = base - (np.cumsum(taken) - taken)[base]
    grammar = Grammar(words[taken], closed[taken])
    near = at - shift[text]
    length = grammar.extend(near, near + q)
    back = grammar.extend_back(near, near + q)
    start, length = at - back, length + back + q
    good = length >= np.maximum(least, 2 * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), bool)  # a stretch keeps its smallest period
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[first], length[first], q[first]
    text = np.searchsorted(base, start, side="right") - 1
    order = np.lexsort((q, start))
    text, start, length, q = text[order], start[order], length[order], q[order]
    return text, start - base[text], length, q


def periodic_copy(n: int, doc_id: int) -> np.ndarray | None:
    """The rule that repeats part of a text: which original word stands at each place, or None for the text as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rewrite=None) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of ``(start, length, period)`` by start and period) and ``kept`` (the words
    that no run repeats, joined by one space). Words are ``[^\\x20\\x09-\\x0D]+``. ``rewrite(n, id)`` may give the
    places of the words that stand for the text's own; rows without an id are not rewritten."""
    common.prepare(docs.sparkSession)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def judge(ids: list, texts: list[bytes]):
        number = defaultdict(count().__next__)
        words, codes = [], []
        for own, text in zip(ids, texts):
            split = text.split()  # ASCII white space
            code = np.fromiter(map(number.__getitem__, split), np.int64, len(split))
            places = rewrite(len(split), own) if rewrite and own is not None else None
            if places is not None:
                split = [split[i] for i in places.tolist()]
                code = code[places]
            words.append(split)
            codes.append(code)
        text, start, length, period = find_runs(codes, least)
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        kept, runs = [], []
        for k, split in enumerate(words):
            part = slice(bounds[k], bounds[k + 1])
            if part.start == part.stop:
                kept.append(b" ".join(split))
                continue
            change = np.zeros(len(split) + 1, np.int64)
            np.add.at(change, start[part] + period[part], 1)
            np.add.at(change, start[part] + length[part], -1)
            kept.append(b" ".join([split[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]))
        runs = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"]),
        )
        return pa.array([len(w) for w in words], pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            a = 0
            while a < len(texts):  # portions of a few words, or one long text
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) < 6 * WORDS):
                    size += len(texts[b])
                    b += 1
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *judge(ids[a:b], texts[a:b])], names=["row", "n_words", "runs", "kept"])
                a = b

    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("kept", T.StringType()),
    ])
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_words", "runs", "kept")]
    return rows.mapInArrow(run, schema).select(*own, "n_words", "runs", "kept")
