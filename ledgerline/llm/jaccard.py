"""N-gram Jaccard join by prefix trees.

A text is its set of word shingles, kept as 62-bit hashes in one global order. Texts of equal
sets form a class, and one text stands for each class.

*Dealing.* A set's shingles are dealt by hash into ``m`` parts, and the hash of a part's shingles is a
signature. Sets that reach the similarity differ in at most ``d`` shingles; with ``m`` above ``d`` by
more than the parts that are empty, they agree in a part that is not. Parts that hold only frequent
shingles (counted over all texts) count as empty where ``m`` allows it, and else are kept. So
linked sets share a signature, and others hardly ever do, though they share a passage. ``m`` follows from the
size class (sizes in a ratio of 1.5); a set close below a class's end also gets the next
class's signatures. Classes that share a signature form a group.

*Joining.* Classes that signatures connect, however indirectly, are a family. Of a block's sets those that share too few shingles with the
others cannot be linked and go, as long as that makes others go. The rest, as their shared shingles in an order from the rarest on,
are stored in a path-compressed trie. Its sets walk it together, so that each path's
overlap is counted once for all that share it, and leave a subtree when what remains of either set
cannot reach the overlap that the lengths require, or when all of it is connected with them already. At an entry the overlap is exact.

A family of at most ``family`` shingles is one block. A larger one is dealt to blocks of about half as many:

1. each block's sets are joined;
2. the first set of each component visits all other blocks of the family;
3. what is connected need not meet again: the sets outside the family's largest component visit all other
   blocks, in batches, and the others only their own.

Every linked pair shares a family, and one of the two visits the other unless they are connected, so no link between components is lost.

Null and empty texts have an empty set and are linked with nothing. Texts of fewer words than
a shingle are one shingle. Rows with the same id count as one document, linked with all that any of
them links with; a null id takes the component of its class or null. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 256
#: Shingles, repeated ones included, of a family that is joined in one block.
FAMILY = 2_000_000
#: Shingles that count as frequent, at most; they only spare work.
HEAVY = 1 << 16
#: Signatures that a task packs at a time, and those of a bucket in which they are counted, about.
PACKED = 1 << 20
#: Ratio of the largest to the smallest size of a size class.
CLASS_RATIO = 1.5


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, n: int) -> np.ndarray:
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    return (common.hash_ngrams(common.hash_words(words), min(n, len(words))) >> np.uint64(2)).astype(np.int64)


def ordered_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles in the global order."""
    return _distinct(shingles(text, n))


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


class Signatures:
    """A set's signatures for the similarity ``num / den``. ``heavy``: frequent shingles, sorted."""

    def __init__(self, num: int, den: int, heavy: np.ndarray | None = None):
        self.num, self.den = num, den
        self.heavy = np.empty(0, np.int64) if heavy is None else heavy
        self.known: dict[int, tuple[int, int]] = {}

    @staticmethod
    def bounds(c: int) -> tuple[int, int]:
        """Least and largest size of a class."""
        return math.ceil(CLASS_RATIO**c), math.ceil(CLASS_RATIO ** (c + 1)) - 1

    def class_of(self, size: int) -> int:
        c = max(0, int(math.log(size) / math.log(CLASS_RATIO)) - 1)
        while self.bounds(c)[1] < size:
            c += 1
        return c

    def parts(self, c: int) -> tuple[int, int]:
        """Parts of a class, and how many shingles linked sets in it may differ by."""
        if c not in self.known:
            low, high = self.bounds(c)
            low = max(1, -(-low * self.num // self.den))  # sets close below belong to it too
            d = 2 * high * (self.den - self.num) // (self.den + self.num)
            m = d + 1
            while m > 1 and m - d <= (empty := m * math.exp(-low / m)) + 4 * math.sqrt(empty) + 0.5 and m < 4 * d + 8:
                m += 1
            self.known[c] = m, d
        return self.known[c]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.empty(0, np.int64)
        c = self.class_of(len(keys))
        hashes = common.mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        rare = np.ones(len(keys), dtype=bool)
        if len(self.heavy):
            rare = self.heavy[np.minimum(np.searchsorted(self.heavy, keys), len(self.heavy) - 1)] != keys
        out = [self._of(hashes, rare, c)]
        if len(keys) * self.den >= self.num * (self.bounds(c)[1] + 1):
            out.append(self._of(hashes, rare, c + 1))
        return np.concatenate(out)

    def _of(self, hashes: np.ndarray, rare: np.ndarray, c: int) -> np.ndarray:
        m, d = self.parts(c)
        part = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        number, start = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(common.mix(hashes[order] + np.uint64(c + 1)), start)
        telling = np.add.reduceat(rare[order].astype(np.int64), start) > 0
        if m - int(telling.sum()) < m - d:  # a telling part is among those that agree
            number, sums = number[telling], sums[telling]
        elif m - len(number) >= m - d:  # so many empty parts that they must count as parts that agree
            empty = np.setdiff1d(np.arange(m), number)
            number, sums = np.concatenate((number, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
        return (common.mix(sums + common.mix(number.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(c))) >> np.uint64(2)).astype(np.int64)


# --- the trie -------------------------------------------------------------------------

#: Shingles of a path that are walked at once: sets that miss too many of them go no further.
_RUN = 64


class Node:
    __slots__ = ("children", "end", "ends", "first", "least", "most", "number", "run", "worth")

    def __init__(self, run: np.ndarray, first: int, end: int):
        self.run, self.first, self.end = run, first, end  # the entries below it
        self.children, self.ends, self.least, self.most, self.worth, self.number = [], [], 1 << 60, 0, 0, 0


def build(arrays: list[np.ndarray], sizes: list[int], worth: list[int]) -> Node:
    """The trie of arrays, which are sorted like their strings. ``sizes``: of the whole sets, whose least
    and most each subtree knows, as it does the most of their ``worth``."""
    root = Node(np.empty(0, np.int64), 0, len(arrays))
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        lo, hi = node.first, node.end
        node.least, node.most, node.worth = min(sizes[lo:hi]), max(sizes[lo:hi]), max(worth[lo:hi])
        while lo < hi and len(arrays[lo]) == depth:
            node.ends.append(lo)
            lo += 1
        while lo < hi:
            first = arrays[lo]
            token, end = first[depth], lo + 1
            while end < hi and arrays[end][depth] == token:
                end += 1
            last = arrays[end - 1]
            n = min(len(first), len(last), depth + _RUN)
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            stop = depth + int(differ[0]) if len(differ) else n
            child = Node(first[depth:stop], lo, end)
            node.children.append(child)
            todo.append((child, stop))
            lo = end
    return root


class Links:
    """Who is connected in a block (union-find)."""

    def __init__(self, groups: list):
        first: dict = {}
        self.up = [first.setdefault(g, i) for i, g in enumerate(groups)]
        self.parts = len(first)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.parts -= 1
        return True


#: Cells of the membership table of the sets that walk together.
_CELLS = 4 << 20


def _sharing(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """The numbers of the sets that may be linked with another one: those that share enough shingles with the rest of them.
    For each, the shared shingles as places in an order from the rarest to the most frequent; the number of places."""
    size = np.asarray([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    left = np.ones(len(sets), dtype=bool)
    while True:  # who goes takes shingles along that others shared with it alone
        shared = np.bincount(owner[count[place] > 1], minlength=len(sets))
        gone = left & (den * shared < num * size)
        left &= ~gone
        drop = gone[owner]
        count -= np.bincount(place[drop], minlength=len(count))
        owner, place = owner[~drop], place[~drop]
        if 16 * int(gone.sum()) <= int(left.sum()):
            break
    kept = np.flatnonzero(count > 1)
    rank = np.full(len(count), -1)
    rank[kept[np.argsort(count[kept], kind="stable")]] = np.arange(len(kept))
    place = rank[place]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.lexsort((place, owner))
    numbers = np.flatnonzero(left)
    return numbers, np.split(place[order], np.searchsorted(owner[order], numbers[1:])) if len(numbers) else [], len(kept)


def linked(home: list[np.ndarray], guests: list[np.ndarray], num: int, den: int, links: Links | None = None, met: bool = False) -> Iterator[tuple[int, int]]:
    """All (set, entry) whose similarity reaches ``num / den``: the sets are the home sets, which
    the trie holds, and then the guests. ``links``, which the caller keeps up to date: pairs that it connects are left out
    as the walk goes on; ``met``: only the guests walk."""
    sets = [*home, *guests]
    if not home:
        return
    numbers, places, universe = _sharing(sets, num, den)
    n_home, both = int(np.searchsorted(numbers, len(home))), num + den
    if not n_home:
        return
    size = np.asarray([len(sets[i]) for i in numbers])
    missing = size - np.asarray([len(x) for x in places])
    worth = den * size - both * missing
    entry = np.asarray(sorted(range(n_home), key=lambda i: places[i].astype(">i8").tobytes()))  # the sets in the order of the trie
    root = build([places[i] for i in entry], size[entry].tolist(), worth[entry].tolist())
    nodes = [root]
    for node in nodes:
        for child in node.children:
            child.number = len(nodes)
            nodes.append(child)
    first, end = np.asarray([n.first for n in nodes]), np.asarray([n.end for n in nodes])

    left = list(range(n_home if met else 0, len(numbers)))  # who has not walked
    waits = np.ones(n_home, dtype=bool)  # entries that have not walked themselves, and all of them once only guests are left
    of, main = np.full(len(numbers), -1), None
    most, step = max(1, _CELLS // max(1, universe)), 4
    while left:
        of_entry = np.arange(n_home)
        if links is not None:
            of = np.asarray([links.find(i) for i in numbers.tolist()])
            of_entry = of[entry]
            if main is None:
                roots, count = np.unique(of, return_counts=True)
                main = int(roots[count.argmax()]) if 2 * count.max() >= len(of) else None
            if main is not None:  # who is outside meets all of the main component
                main = links.find(main)
                left = [i for i in left if i >= n_home or of[i] != main]
        step = min(step, most)
        if left and left[0] < n_home <= left[min(step, len(left)) - 1]:
            step = sum(i < n_home for i in left)
        part, left = left[:step], left[step:]
        if not part:
            break
        if part[0] >= n_home:
            waits[:] = True
        step *= 8
        # the component of all entries below a node that still wait, -1: several, -2: none waits
        waiting = waits[entry] if links is not None else np.ones(n_home, dtype=bool)
        until = np.concatenate(([0], np.cumsum(waiting)))
        seen = of_entry[waiting]
        changes = np.concatenate(([0], np.cumsum(seen[1:] != seen[:-1]))) if len(seen) else np.zeros(1, np.int64)
        a, b = until[first], until[end]
        last = max(0, len(seen) - 1)
        one = changes[np.minimum(a, last)] == changes[np.clip(b - 1, 0, last)]
        only = np.where(a == b, -2, np.where(one, seen[np.minimum(a, last)] if len(seen) else -2, -1)).tolist()

        mine, free, its = size[part], missing[part], of[part]
        holds = np.zeros((len(part), universe), dtype=bool)
        holds[np.repeat(np.arange(len(part)), [len(places[i]) for i in part]), np.concatenate([places[i] for i in part])] = True
        passed = np.cumsum(holds, axis=1, dtype=np.int32)
        todo = [(root, np.arange(len(part)), np.zeros(len(part), np.int64), 0)]
        while todo:
            node, who, matched, depth = todo.pop()
            if only[node.number] == -2:
                continue
            fits = (den * node.most >= num * mine[who]) & (num * node.least <= den * mine[who])
            if links is not None:
                fits &= its[who] != only[node.number]
            who, matched = who[fits], matched[fits]
            if not len(who):
                continue
            if len(node.run):
                matched = matched + holds[who[:, None], node.run].sum(1)
                depth += len(node.run)
                missed = free[who] + passed[who, node.run[-1]] - matched
                # overlap <= size - missed and <= other - what the other misses must reach num / (num + den) of both sizes
                fits = (both * (mine[who] - missed) >= num * (mine[who] + node.least)) & (node.worth - both * (depth - matched) >= num * mine[who])
                who, matched = who[fits], matched[fits]
            for j in node.ends:
                if waiting[j]:
                    fits = den * matched >= num * (mine[who] + int(size[entry[j]]) - matched)
                    if links is not None:
                        fits &= its[who] != of_entry[j]
                    for i in who[fits].tolist():
                        yield int(numbers[part[i]]), int(numbers[entry[j]])
            if len(who):
                todo += [(c, who, matched, depth) for c in node.children]
        waits[[i for i in part if i < n_home]] = False


def link_block(
    home: list[np.ndarray], num: int, den: int, guests: list[np.ndarray] = (), groups: list | None = None, met: bool = False,
) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a block and its guests (numbered after the
    home sets); ``groups``: what is connected already; ``met``: pairs of home sets are known."""
    links = Links(list(range(len(home) + len(guests))) if groups is None else groups)
    out: list[tuple[int, int]] = []
    for i, j in linked(home, list(guests), num, den, links, met):
        if links.parts == 1:
            break
        if links.join(i, j):
            out.append((i, j))
    return out


# --- Spark jobs ---------------------------------------------------------------------


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int, limit: int = HEAVY) -> DataFrame:
    """``id, n, digest`` of each row and, in rows of their own, ``key, times`` of the most frequent shingles of each task, as far as
    it meets them three times among some thousand texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen: dict[int, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            nonlocal held, size, seen
            keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            for k, c in zip(keys[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
                seen[k] = seen.get(k, 0) + c
            if len(seen) > 4 * limit:
                seen = dict(sorted(seen.items(), key=lambda e: -e[1])[:limit])
            held, size = [], 0

        def rows(**columns) -> pa.RecordBatch:
            size = max(map(len, columns.values()))
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()], names=[*kinds])

        for batch in batches:
            sizes, digests = [], []
            for text in batch.column(1).to_pylist():
                held.append(shingles(text, n))
                own = _distinct(held[-1])
                sizes.append(len(own))
                digests.append(xxh3_128_digest(own.tobytes()))
                size += len(held[-1])
                if size > 1_000_000:
                    fold()
            yield rows(id=batch.column(0), n=sizes, digest=digests)
        fold()
        top = sorted(seen.items(), key=lambda e: -e[1])[:limit]
        yield rows(key=[k for k, _ in top], times=[c for _, c in top])

    kinds = {"id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "key": pa.int64(), "times": pa.int64()}
    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, "id bigint, n bigint, digest binary, key bigint, times bigint")


def frequent(sets: DataFrame, limit: int = HEAVY) -> np.ndarray:
    """The most frequent shingles of all texts, at most ``limit``, of those that a task of :func:`_sets` lists.
    They decide which parts are spared, not the result."""
    counted = sets.where("key is not null").groupBy("key").agg(F.sum("times").alias("n"))
    top = counted.orderBy(F.desc("n"), "key").limit(limit).select("key").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64))


def _signed(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, n: int, num: int, den: int, heavy) -> DataFrame:
    """``class, signatures`` (64-bit integers) of the texts that stand for a class, and of few others."""
    ids = classes.select("class").distinct()
    member = common.bloom(ids, "class", ids.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(num, den, heavy.value)
        for batch in batches:
            kept = batch.filter(pa.array(member.value.test(batch.column(0).to_numpy(zero_copy_only=False))))
            got = [signatures.of(ordered_set(text, n)).tobytes() for text in kept.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(got, pa.binary())], names=["class", "signatures"])

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("class"), F.col(f"`{text_col}`").alias("text")).where("class is not null")
    return read.mapInArrow(run, "class bigint, signatures binary")


def _exploded(signed: DataFrame, shared) -> DataFrame:
    """``token, class`` for each signature; ``shared``: a Bloom filter of those wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
            tokens = np.concatenate(lists) if lists else np.empty(0, np.int64)
            owner = np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists])
            keep = shared.value.test(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(owner[keep])], names=["token", "class"])

    return signed.select("class", "signatures").mapInArrow(run, "token bigint, class bigint")


def _often(signed: DataFrame, packed: int = PACKED) -> DataFrame:
    """``token`` of the signatures that occur twice or more. Tasks send them as sorted arrays to buckets of bounded size,
    since most occur once: an aggregate of the rows fills the executors with a hash table that saves next to nothing."""
    total = signed.agg(F.sum(F.length("signatures"))).first()[0] or 0
    buckets = max(1, -(-total // (8 * packed)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            # of 62 bits, dealt evenly: a bucket is a range
            numbers, start = np.unique((tokens >> 30) * buckets >> 32, return_index=True)
            parts = [(tokens[a:b], counts[a:b] > 1) for a, b in zip(start, [*start[1:], len(tokens)], strict=True)]
            columns = [pa.array(numbers), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*parts, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "tokens", "often"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, np.int64))
                size += len(held[-1])
                if size >= packed:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 1):
            tokens = np.concatenate([np.frombuffer(r[1], np.int64) for r in group])
            often = np.concatenate([np.frombuffer(r[2], bool) for r in group])
            order = np.argsort(tokens, kind="stable")  # merges the sorted arrays
            tokens, often = tokens[order], often[order]
            often[1:] |= tokens[1:] == tokens[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(tokens[often]))], names=["token"])

    parts = signed.select("signatures").mapInArrow(pack, "bucket bigint, tokens binary, often binary")
    return parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "token bigint")


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``class, text`` of the wanted classes (and, before the exact join, of few others); the
    text is compressed, since it is shuffled."""
    ids = wanted.select("class").distinct()
    member = common.bloom(ids, "class", ids.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            kept = batch.filter(pa.array(member.value.test(batch.column(0).to_numpy(zero_copy_only=False))))
            texts = [pack((x or "").encode("utf-8", "surrogatepass")) for x in kept.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(texts, pa.binary())], names=["class", "text"])

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("class"), F.col(f"`{text_col}`").alias("text")).where("class is not null")
    return read.mapInArrow(run, "class bigint, text binary")


def _unpacked(text: bytes) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(text).decode("utf-8", "surrogatepass")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first ``keys`` columns."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _distinct_groups(shared: DataFrame) -> DataFrame:
    """One signature of those that the very same classes share (copies of a text with
    few changes agree in most parts, and need to meet once)."""
    h = F.xxhash64("class").cast("decimal(38,0)")
    members = shared.groupBy("token").agg(F.count("*").alias("g"), F.sum(h).alias("a"), F.sum(F.xxhash64("class", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    kept = members.where("g > 1").groupBy("g", "a", "b").agg(F.min("token").alias("token")).select("token")
    return shared.join(kept, "token")


def _dealt(rows: DataFrame, family: int) -> DataFrame:
    """``rows`` (``class, token, size``: a large family and its shingles) with ``blocks`` and ``blk``, the class's own."""
    rows = rows.withColumn("blocks", F.ceil(2 * F.col("size") / family).cast("bigint"))
    return rows.withColumn("blk", F.pmod(F.xxhash64("class", "token"), F.col("blocks"))).drop("size")


def _visits(large: DataFrame, labels: DataFrame, name: str, some: bool) -> DataFrame:
    """``class, token, blk, component, guest`` of families of several components: all sets in their own blocks, and those
    outside the largest component as guests in the others. ``some``: only the first set of each component of several."""
    rows = large.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("single", F.col("component").isNull())
    rows = rows.withColumn("component", F.coalesce("component", "class"))
    counts = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    groups = counts.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1").drop("parts")
    mixed = common.materialize(rows.join(groups, "token"), name)
    stored = mixed.select("class", "token", "blk", "component", F.lit(False).alias("guest"))
    guests = mixed.where("class = component and not single") if some else mixed.where("component <> main")
    guests = guests.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).where("to <> blk")
    return stored.union(guests.select("class", "token", F.col("to").alias("blk"), "component", F.lit(True).alias("guest")))


def _joined(docs: DataFrame, id_col: str, text_col: str, dealt: DataFrame, n: int, num: int, den: int, block: int, met: bool = False) -> DataFrame:
    """Links that connect the linked sets of each block. ``met``: pairs of a block's own sets are known. Guests come
    in batches, of ``block`` sets at least, and as many shingles as the block has."""
    texts = _texts(docs, id_col, text_col, dealt).join(dealt, "class").select("token", "blk", "guest", "class", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, itemgetter(0, 1)):
            home, guests = ([], []), ([], [])  # classes and sets
            name: dict[int, int] = {}  # of the components, as links join them

            def links(home=home, guests=guests, name=name) -> pa.RecordBatch:
                sets, groups = [*home[1], *guests[1]], [*home[0], *guests[0]]
                found = link_block(home[1], num, den, guests[1], [_named(name, c) for _, c in groups], met) if len(sets) > 1 else []
                for i, j in found:
                    name[_named(name, groups[i][1])] = _named(name, groups[j][1])
                return _pairs_batch([(groups[i][0], groups[j][0]) for i, j in found])

            size = 0
            for _, _, guest, one, component, text in group:  # home sets come before guests
                to = guests if guest else home
                to[0].append((one, component))
                to[1].append(ordered_set(_unpacked(text), n))
                size += len(to[1][-1]) if guest else -len(to[1][-1])
                if guest and len(guests[1]) >= block and size >= 0:
                    yield links()
                    size -= sum(map(len, guests[1]))
                    for x in guests:
                        x.clear()
            if guests[1] or not met:
                yield links()

    parts = texts.repartition("token", "blk").sortWithinPartitions("token", "blk", "guest")
    return parts.mapInArrow(run, "a bigint, b bigint").where("a <> b")


def _named(name: dict[int, int], c: int) -> int:
    while c in name:
        c = name[c]
    return c


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 3, num: int = 90, den: int = 100, block: int = BLOCK,
    family: int = FAMILY,
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: texts are linked when ``den`` times the
    sets' intersection reaches ``num`` times their union, and a component is named
    by its smallest id."""
    common.prepare(docs.sparkSession)
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    read = common.materialize(_sets(docs, id_col, text_col, n), "ngram-sets")
    sets = read.where("n is not null").select("id", "n", "digest")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("class"), F.max("n").alias("n"))
    classes = common.materialize(classes.where("class is not null"), "ngram-classes")
    heavy = docs.sparkSession.sparkContext.broadcast(frequent(read))
    signed = _signed(docs, id_col, text_col, classes, n, num, den, heavy)
    signed = common.materialize(signed, "ngram-signatures")
    often = common.materialize(_often(signed), "ngram-often")
    shared = _exploded(signed, common.bloom(often, "token", often.count())).join(often, "token")
    # the Bloom filters let other rows pass; only texts that stand for a class are joined, once a signature
    shared = shared.join(classes.select("class").distinct(), "class", "left_semi").distinct()
    shared = common.materialize(_distinct_groups(shared.select("token", "class")), "ngram-shared")

    ends = shared.groupBy("token").agg(F.min("class").alias("b"))
    of_family = common.components(shared.join(ends, "token").select(F.col("class").alias("a"), "b"), name="ngram-families")
    of_family = of_family.withColumnsRenamed({"component": "family", "node": "class"})
    sizes = of_family.join(classes.groupBy("class").agg(F.max("n").alias("n")), "class").groupBy("family").agg(F.sum("n").alias("size"))
    of_family = common.materialize(of_family.join(sizes, "family"), "ngram-family")
    whole = of_family.where(F.col("size") <= family).select(
        "class", F.col("family").alias("token"), F.lit(0).cast("bigint").alias("blk"), F.col("class").alias("component"), F.lit(False).alias("guest"))
    links = _joined(docs, id_col, text_col, whole, n, num, den, block)
    large = common.materialize(_dealt(of_family.where(F.col("size") > family).select("class", F.col("family").alias("token"), "size"), family), "ngram-large")
    if not large.isEmpty():
        own = large.select("class", "token", "blk", F.col("class").alias("component"), F.lit(False).alias("guest"))
        near = common.materialize(_joined(docs, id_col, text_col, own, n, num, den, block), "ngram-near")
        for some in (True, False):  # few sets join most of the blocks' components, then all that is still apart meets
            dealt = common.materialize(_visits(large, common.components(near, name="ngram-cc"), "ngram-mixed", some), "ngram-visits")
            near = common.materialize(near.unionByName(_joined(docs, id_col, text_col, dealt, n, num, den, block, met=True)), "ngram-near")
        links = links.unionByName(near)
    labels = common.components(links, name="ngram-links")

    class_of = classes.select("digest", "class")
    rows = sets.select("id", F.col("n").alias("n_shingles"), "digest").join(class_of, "digest", "left")
    rows = rows.join(labels.withColumnRenamed("node", "class"), "class", "left")
    return rows.select("id", "n_shingles", F.coalesce("component", "class", "id").alias("component_id"))
