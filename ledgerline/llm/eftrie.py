"""Language-model scoring with an n-gram trie in Elias-Fano coded, memory-mapped levels.

*Model.* Word probabilities are ``p(v) = (c(v) + 1/2) / (N + (V + 1) / 2)`` over the training tokens
(words, and one end for each text). After a word ``u`` seen ``min_count`` times (or at a text's begin)
``p(v | u) = a(u, v) + g(u) p(v)``, where ``a`` is the absolutely discounted share of a pair seen at
least ``least`` times, rounded down to one of 255 steps of its logarithm, and ``g(u)`` is what the
rounded shares leave of 1, so the model stays a probability. With ``order`` 3,
``p(w | u, v) = ((c(u, v, w) - d) + d n(u, v) p(w | v)) / c(u, v)`` after a pair that training texts show, with exact
counts; ``n`` is the number of its distinct successors. The registered query prunes nothing
(``min_count`` and ``least`` 1, ``order`` 3); the defaults of the functions do.

*Levels.* Words are 63-bit hashes, dealt by their first bits to shards of bounded size. A shard of the
first level holds its sorted hashes (Elias-Fano), counts (a byte, with exceptions) and the
numbers of its frequent words. A shard of the second level holds its contexts (Elias-Fano),
the successors, each relative to its context (Elias-Fano),
and the quantised shares. Contexts are dealt by hash, and the successors of one that is too
frequent for a shard are dealt again. Back-off weights lie in a set of files of their own. A shard of the
third level holds pairs as contexts, their pointers into the successors and the sums of the counts before
them (all Elias-Fano), the successors, and counts (a byte, with exceptions); it is dealt like the second.

*Jobs.* Tasks count words, and Spark sums them; then tasks count pairs and triples and send them, sorted and
packed, to the shards, which add them up. The levels are files in the shared folder that
the index tables name; every task maps them into memory, and looks up the distinct
words and pairs of about a million tokens at a time, shard by shard.

Null texts are empty (an end alone). A null id counts as the empty string. Repeated rows are
counted and scored each. Empty tables give no rows; without training texts every word is unknown.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import common
from .warc import open_folder

#: Occurrences that make a word frequent, unless the caller says otherwise: only such words form pairs.
MIN_COUNT = 3
#: Entries of a shard, about.
SHARD = 1 << 20
#: Tokens that a task looks up or counts at a time.
GROUP = 1 << 20
END = (1 << 63) - 1
_STEP = 0.05  # of the quantised log10 shares
_M63 = np.uint64((1 << 63) - 1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    real = pc.binary_length(words).to_numpy() > 0  # there are empty ones before and after a text's outer white space
    if not real.all():
        before, end = np.concatenate(([0], np.cumsum(real))), np.cumsum(n)
        words, n = words.filter(pa.array(real)), before[end] - before[end - n]
    return words, n


def tokens_of(words: list[pa.Array], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of texts (hashes of their words, and the end) in order, and each token's place among them.
    A distinct word is hashed once. ``lengths``: tokens of each text, the end with them."""
    coded = pa.concat_arrays([w.cast(pa.large_binary()) for w in words]).dictionary_encode()
    own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
    hashes = np.append(common.hash_words(own) >> np.uint64(1), np.uint64(END)).astype(np.int64)
    distinct, place = np.unique(hashes, return_inverse=True)
    tokens, is_word = np.full(int(lengths.sum()), place[-1]), np.ones(int(lengths.sum()), dtype=bool)
    is_word[np.cumsum(lengths) - 1] = False
    tokens[is_word] = place[coded.indices.to_numpy()]
    return distinct, tokens


# --- Elias-Fano ---------------------------------------------------------------------


class EliasFano:
    """A sorted sequence of integers (distinct, where they are looked for): the low bits packed, the high bits in unary,
    and the zeros before each 64-bit word of the latter."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.zeros = n, low_bits, lows, highs, zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        lows = pack_bits(values & ((1 << low_bits) - 1), low_bits)
        at = (values >> low_bits) + np.arange(n)
        words = (int(at[-1]) if n else 0) // 64 + 2
        highs = np.zeros(words, dtype=np.uint64)
        np.bitwise_or.at(highs, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.bitwise_count(highs).astype(np.int64)
        zeros = (np.arange(words) * 64 - np.concatenate(([0], np.cumsum(ones)[:-1]))).astype(np.int64)
        return cls(n, low_bits, lows, highs, zeros)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0)."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _nth_bits(~np.asarray(self.highs[word]), k - np.asarray(self.zeros[word]))  # beyond the last word all are zeros

    def _zero_from(self, place: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero, which is the first one from ``place`` on."""
        word = np.minimum(place >> 6, len(self.highs) - 1)
        rest = ~np.asarray(self.highs[word]) >> (place & 63).astype(np.uint64)
        out = place + np.bitwise_count((rest & -rest) - _ONE)
        far = np.flatnonzero((rest == 0) | (word != place >> 6))
        out[far] = self._select0(k[far])
        return out

    def low(self, i: np.ndarray) -> np.ndarray:
        return unpack_bits(self.lows, i, self.low_bits)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th one (from 0)."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - np.asarray(self.zeros)
        word = np.searchsorted(ones, i, "right") - 1
        return word * 64 + _nth_bits(np.asarray(self.highs[word]), i - ones[word])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places."""
        return ((self._select1(i) - i) << self.low_bits) | self.low(i)

    def steps(self, i: np.ndarray) -> np.ndarray:
        """By how much the next value is greater than that at places."""
        place, after = self._select1(i), i + 1
        rest = np.asarray(self.highs[place >> 6]) & (~_ONE << (place & 63).astype(np.uint64))  # the ones after it in its word
        following = (place | 63) - 63 + np.bitwise_count((rest & -rest) - _ONE)
        far = np.flatnonzero(rest == 0)
        following[far] = self._select1(after[far])
        return ((following - place - 1) << self.low_bits) + self.low(after) - self.low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The places of values, -1 for those that are not there."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return out
        high = values >> self.low_bits
        known = np.flatnonzero((high >= 0) & (high < int(self.zeros[-1]) + 64))
        if not len(known):
            return out
        h, low = high[known], values[known] & ((1 << self.low_bits) - 1)
        place = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) + 1, 0)
        begin, end = place - h, np.minimum(self._zero_from(place, h) - h, self.n)
        some = np.flatnonzero(begin < end)
        known, low, begin, end = known[some], low[some], begin[some], end[some]
        open_ = np.flatnonzero(end - begin > 1)
        while len(open_):  # binary search of the low bits among those of one high part, for the last that is not greater
            a, b = begin[open_], end[open_]
            middle = (a + b) >> 1
            greater = self.low(middle) > low[open_]
            begin[open_], end[open_] = a, b = np.where(greater, a, middle), np.where(greater, middle, b)
            open_ = open_[b - a > 1]
        ok = np.flatnonzero(self.low(begin) == low)
        out[known[ok]] = begin[ok]
        return out

    def values(self) -> np.ndarray:
        """All of them."""
        at = np.flatnonzero(np.unpackbits(np.asarray(self.highs).astype("<u8").view(np.uint8), bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)) << self.low_bits) | self.low(np.arange(self.n))

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits], np.int64), f"{name}.lows": self.lows, f"{name}.highs": self.highs, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = (int(x) for x in arrays[f"{name}.head"])
        return cls(n, low_bits, arrays[f"{name}.lows"], arrays[f"{name}.highs"], arrays[f"{name}.zeros"])


#: The place of the n-th set bit of a byte.
_NTH_BIT = np.array([[*[i for i in range(8) if b >> i & 1], *[7] * 8][:8] for b in range(256)], dtype=np.int64)
_ONE = np.uint64(1)
_BYTES = np.uint64(0x0101010101010101)


def _nth_bits(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit (from 0, below 128) of each 64-bit word; 64 where it has fewer."""
    s = words - (words >> _ONE & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + (s >> np.uint64(2) & np.uint64(0x3333333333333333))
    s = (s + (s >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES  # in each byte the set bits up to its end
    high, n = np.uint64(0x8080808080808080), n.astype(np.uint64)
    byte = np.bitwise_count(((n * _BYTES) | high) - s & high).astype(np.uint64)  # those that end before the bit
    at = np.minimum(byte, np.uint64(7)) * np.uint64(8)
    nth = np.minimum(n - (s << np.uint64(8) >> at & np.uint64(255)), np.uint64(7))
    return np.where(byte > 7, 64, at.astype(np.int64) + _NTH_BIT[(words >> at & np.uint64(255)).astype(np.int64), nth.astype(np.int64)])


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Integers of ``width`` bits one after the other in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        v, shift = values.astype(np.uint64), (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, at >> 6, v << shift)
        over = shift > 0
        np.bitwise_or.at(out, (at[over] >> 6) + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack_bits(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=np.int64)
    at = i * width
    if width <= 57:  # they lie within the eight bytes from that of their first bit on
        data = np.asarray(words).view(np.uint8)
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    first, second = np.asarray(words[word]) >> shift, np.asarray(words[word + 1])
    second = np.where(shift > 0, second << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((first | second) & np.uint64((1 << width) - 1)).astype(np.int64)


# --- files ------------------------------------------------------------------------------


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays to a new file of the folder and returns its name."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    name, at, head, body = f"{uuid.uuid4().hex}.ef", 0, {}, []
    for k, v in arrays.items():
        data = np.ascontiguousarray(v).tobytes()
        head[k] = (v.dtype.str, len(v), at)
        body += [data, bytes(-len(data) % 8)]
        at += len(data) + -len(data) % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with system.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for x in body:
            f.write(x)
    return name


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the folder is a file system's own."""
    from pyarrow import fs

    system, path = open_folder(folder)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r").view(np.ndarray)
    else:
        with system.open_input_file(f"{path}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    head, start = json.loads(data[8 : 8 + size].tobytes()), 8 + size
    return {k: data[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head.items()}


class Words:
    """A shard of the first level."""

    @staticmethod
    def arrays(hashes: np.ndarray, counts: np.ndarray, min_count: int) -> dict[str, np.ndarray]:
        large, frequent = np.flatnonzero(counts >= 255), np.flatnonzero((counts >= min_count) & (hashes != END))
        return EliasFano.encode(hashes).parts("hash") | {
            "code": np.minimum(counts, 255).astype(np.uint8), "large": large.astype(np.uint32), "count": counts[large].astype(np.int64), "frequent": frequent.astype(np.uint32),
        }

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.hash = arrays, EliasFano.of(arrays, "hash")

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and the place among the shard's frequent words or -1."""
        at = self.hash.find(hashes)
        count, number = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        found = np.flatnonzero(at >= 0)
        code = np.asarray(self.a["code"][at[found]]).astype(np.int64)
        big = code == 255
        code[big] = self.a["count"][np.searchsorted(self.a["large"], at[found][big])]
        count[found] = code
        frequent = self.a["frequent"]
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, at[found]), len(frequent) - 1)
            number[found] = np.where(frequent[place] == at[found], place, -1)
        return count, number


class Pairs:
    """A shard of the second level."""

    @staticmethod
    def arrays(u: np.ndarray, v: np.ndarray, code: np.ndarray, size: int) -> dict[str, np.ndarray]:
        """Sorted by context and successor; ``size``: bound of the successors' numbers."""
        contexts, row = np.unique(u, return_inverse=True)
        return EliasFano.encode(contexts).parts("context") | EliasFano.encode(row * size + v).parts("successor") | {"code": code, "size": np.array([size], np.int64)}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.context, self.successor = EliasFano.of(arrays, "context"), EliasFano.of(arrays, "successor")
        self.code, self.size = arrays["code"], int(arrays["size"][0])

    def look(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The codes of the pairs, 0 for those that are not stored."""
        out = np.zeros(len(u), dtype=np.uint8)
        first = np.append(True, u[1:] != u[:-1])[: len(u)]
        row = self.context.find(u[first])[np.cumsum(first) - 1]
        known = np.flatnonzero(row >= 0)
        at = self.successor.find(row[known] * self.size + v[known])
        found = at >= 0
        out[known[found]] = self.code[at[found]]
        return out


class Triples:
    """A shard of the third level: pairs as contexts (``u * size + v``), and their successors' counts."""

    @staticmethod
    def arrays(contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
        """``contexts``: sorted; ``keys``: sorted, the context's place times ``size`` and the successor."""
        pointers = np.searchsorted(keys // size, np.arange(len(contexts) + 1))
        sums = np.concatenate(([0], np.cumsum(counts)))[pointers]
        large = np.flatnonzero(counts >= 255)
        return (
            EliasFano.encode(contexts).parts("context") | EliasFano.encode(pointers).parts("pointer") | EliasFano.encode(sums).parts("sum")
            | EliasFano.encode(keys).parts("successor")
            | {"code": np.minimum(counts, 255).astype(np.uint8), "large": large.astype(np.uint32), "count": counts[large].astype(np.int64), "size": np.array([size], np.int64)}
        )

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.size = arrays, int(arrays["size"][0])
        self.context, self.pointer, self.sum, self.successor = (EliasFano.of(arrays, x) for x in ("context", "pointer", "sum", "successor"))

    def look_contexts(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts' places (-1: not here), how many distinct successors they have here, and how often these follow."""
        distinct, total = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        row = self.context.find(contexts)
        known = np.flatnonzero(row >= 0)
        for out, sequence in ((distinct, self.pointer), (total, self.sum)):
            out[known] = sequence.steps(row[known])
        return row, distinct, total

    def look(self, place: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The counts of successors ``v`` of the contexts at places."""
        out = np.zeros(len(place), dtype=np.int64)
        known = np.flatnonzero(place >= 0)
        at = self.successor.find(place[known] * self.size + v[known])
        known, at = known[at >= 0], at[at >= 0]
        code = np.asarray(self.a["code"][at]).astype(np.int64)
        big = code == 255
        code[big] = self.a["count"][np.searchsorted(self.a["large"], at[big])]
        out[known] = code
        return out


def share_codes(share: np.ndarray) -> np.ndarray:
    """1 to 255: the steps of the logarithm below 0, rounded down; 0 where it is smaller still."""
    code = np.ceil(-np.log10(np.maximum(share, 1e-300)) / _STEP - 1e-9) + 1
    return np.where((share > 0) & (code <= 255), np.maximum(code, 1), 0).astype(np.uint8)


#: The share of each code.
SHARES = np.concatenate(([0.0], 10 ** (-_STEP * np.arange(255))))


# --- the model -------------------------------------------------------------------------


class Model:
    """What tasks need to open the levels. The file names are one for about a million entries."""

    def __init__(self, folder: str, n: int, v: int, bits: int, shard: int = SHARD):
        self.folder, self.n, self.v, self.bits, self.size = folder, n, v, bits, shard
        self.words: dict[int, tuple[str, int]] = {}  # shard: file, number of its first frequent word
        self.frequent = 0
        self.pairs: dict[tuple[int, int], str] = {}
        self.shards = 1
        self.hot: dict[int, int] = {}  # contexts whose successors are dealt again, into how many
        self.rests: dict[int, str] = {}
        self.order = 2
        self.triples: dict[int, str] = {}
        self.triple_shards = 1
        self.triple_discount = 0.0

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))

    def look_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers (-1: not frequent) of sorted distinct hashes."""
        count, number = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        shard = hashes >> (63 - self.bits)
        for s, a, b in _spans(shard):
            if s in self.words:
                name, first = self.words[s]
                count[a:b], places = Words(load(self.folder, name)).look(hashes[a:b])
                number[a:b] = np.where(places >= 0, places + first, -1)
        return count, number

    def _hot_rows(self, u: np.ndarray, size: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The rows of sorted ``u`` whose word (the number, or of a pair ``size`` times it and the next) is hot, and into how many it is dealt."""
        hot = np.fromiter(sorted(self.hot), np.int64, len(self.hot))
        first = np.searchsorted(u, hot * size)
        n = np.searchsorted(u, (hot + 1) * size) - first
        return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n), np.repeat(np.asarray([self.hot[x] for x in hot.tolist()], np.int64), n)

    def shard_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The second level's shard of each pair (``u`` sorted)."""
        key = u.astype(np.uint64)
        if self.hot:
            rows, ways = self._hot_rows(u)
            key[rows] += (_rest(common.mix(v[rows].astype(np.uint64) + np.uint64(77)), ways.astype(np.uint64)) + np.uint64(1)) << np.uint64(44)
        return _rest(common.mix(key + np.uint64(12345)), np.uint64(self.shards)).astype(np.int64)

    def look_pairs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        shard = self.shard_of(u, v)
        out, order = np.zeros(len(u), np.uint8), _order(shard, self.shards)
        for s, a, b in _spans(shard[order]):
            if s in self.pairs:
                rows = order[a:b]
                out[rows] = Pairs(load(self.folder, self.pairs[s])).look(u[rows], v[rows])
        return out

    def ways(self, contexts: np.ndarray) -> np.ndarray:
        """Into how many the successors of pairs (sorted) are dealt: a pair is no more frequent than its rarer word."""
        out = np.ones(len(contexts), np.int64)
        if self.hot:
            size = self.frequent + 2
            rows, ways = self._hot_rows(contexts, size)
            v = contexts[rows] - contexts[rows] // size * size
            order = np.argsort(v)
            also, again = self._hot_rows(v[order])
            out[rows[order[also]]] = np.minimum(ways[order[also]], again)
        return out

    def triple_shard(self, contexts: np.ndarray, way: np.ndarray) -> np.ndarray:
        key = common.mix(contexts.astype(np.uint64) + np.uint64(54321)) + way.astype(np.uint64)
        return _rest(common.mix(key), np.uint64(self.triple_shards)).astype(np.int64)

    @staticmethod
    def way_of(ways: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The way of successors ``w`` of pairs that are dealt into so many."""
        out, many = np.zeros(len(w), np.int64), np.flatnonzero(ways > 1)
        out[many] = common.mix(w[many].astype(np.uint64) + np.uint64(77)) % ways[many].astype(np.uint64)
        return out

    def look_triples(self, contexts: np.ndarray, row: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct successors and occurrences of sorted distinct pairs, and the counts of the
        successors ``w`` (-1: no word) of ``contexts[row]``."""
        ways = self.ways(contexts)
        place, start = np.repeat(np.arange(len(contexts)), ways), np.cumsum(ways) - ways
        shard = self.triple_shard(contexts[place], np.arange(len(place)) - np.repeat(start, ways))
        words = np.flatnonzero(w >= 0)
        own = shard[start[row[words]] + self.way_of(ways[row[words]], w[words])]
        order = _order(own, self.triple_shards)
        spans = {s: words[order[a:b]] for s, a, b in _spans(own[order])}
        # two ways of a context may lie in one shard, which is asked once
        asked = _distinct(shard * max(1, len(contexts)) + place)
        shard = asked // max(1, len(contexts))
        place = asked - shard * max(1, len(contexts))
        distinct, total, count = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64), np.zeros(len(row), np.int64)
        found_at = np.empty(len(contexts), np.int64)  # in the shard that is open
        for s, a, b in _spans(shard):
            if s not in self.triples:
                continue
            at, level = place[a:b], Triples(load(self.folder, self.triples[s]))
            found, n, occurrences = level.look_contexts(contexts[at])
            distinct[at] += n
            total[at] += occurrences
            if s in spans:
                rows, found_at[at] = spans[s], found
                count[rows] = level.look(found_at[row[rows]], w[rows])
        return distinct, total, count

    def look_rests(self, u: np.ndarray) -> np.ndarray:
        """The back-off weights of sorted distinct contexts."""
        out = np.ones(len(u))
        for s, a, b in _spans(u // self.size):
            if s in self.rests:
                out[a:b] = np.asarray(load(self.folder, self.rests[s])["rest"])[u[a:b] - s * self.size] / 65535.0
        return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is several times faster than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _rest(values: np.ndarray, n) -> np.ndarray:
    """``values % n``; numpy divides by one number several times faster than it takes rests."""
    return values - values // n * n


def _order(values: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of values from 0 to below ``bound``; numpy sorts short integers by their digits."""
    return np.argsort(values.astype(np.uint16) if bound <= 1 << 16 else values, kind="stable")


def _spans(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(sorted_values):
        return []
    start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return list(zip(sorted_values[start].tolist(), start.tolist(), [*start[1:].tolist(), len(sorted_values)], strict=True))


def _grouped(batches: Iterator[pa.RecordBatch], text_at: int, take: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], group: int) -> Iterator[pa.RecordBatch]:
    """Rows in groups of about ``group`` tokens: their other columns, the distinct tokens, each token's place among these,
    and each row's number of tokens."""
    rows: list[pa.RecordBatch] = []
    held: list[pa.Array] = []
    lengths: list[np.ndarray] = []
    size = 0

    def taken() -> Iterator[pa.RecordBatch]:
        n = np.concatenate(lengths)
        distinct, tokens = tokens_of(held, n)
        held.clear()
        yield from take(pa.Table.from_batches(rows), distinct, tokens, n)

    for batch in batches:
        words, n = words_of(batch.column(text_at))
        others, ends, first = batch.select([i for i in range(batch.num_columns) if i != text_at]), np.cumsum(n), 0
        tokens = ends + np.arange(1, len(n) + 1)
        while first < len(n):
            before = (int(ends[first - 1]), int(tokens[first - 1])) if first else (0, 0)
            last = min(len(n), int(np.searchsorted(tokens, group - size + before[1])) + 1)  # its last row reaches the group's size
            rows.append(others.slice(first, last - first))
            held.append(words.slice(before[0], int(ends[last - 1]) - before[0]))
            lengths.append(n[first:last] + 1)
            size += int(tokens[last - 1]) - before[1]
            first = last
            if size >= group:
                yield from taken()
                rows, held, lengths, size = [], [], [], 0
    if rows:
        yield from taken()


def _contexts(model: Model, distinct: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each distinct token: count and number; of each token: its number, and its context's (the begin's is ``model.frequent``)."""
    count, numbers = model.look_words(distinct)
    numbers[-1] = model.frequent + 1  # the end succeeds, but is no context
    number = numbers[tokens]
    context = np.empty_like(number)
    context[1:] = number[:-1]
    context[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = model.frequent
    return count, numbers, number, context


def _before(context: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The tokens that follow a pair (with the begin) of their text; the pair is that of the token before."""
    follows = np.append(False, (context[1:] >= 0) & (context[:-1] >= 0))[: len(context)]
    follows[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = False
    return np.flatnonzero(follows)


def _used(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values at some place of ``at``, in their order, and each place among them."""
    used = np.zeros(len(values), dtype=bool)
    used[at] = True
    return values[used], (np.cumsum(used) - 1)[at]


def _count_words(train: DataFrame, group: int) -> DataFrame:
    """``h, c`` of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(rows: pa.Table, distinct: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(tokens, minlength=len(distinct)).astype(np.int64))], names=["h", "c"])

        yield from _grouped(batches, 0, take, group)

    return train.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of one value in the first column: the other columns' arrays."""
    key, held = None, []
    for batch in batches:
        values = batch.column(0).to_numpy()
        columns = [c.to_numpy() for c in batch.columns[1:]]
        cuts = [0, *(1 + np.flatnonzero(values[1:] != values[:-1])).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            if a == b:
                continue
            if key is not None and values[a] != key:
                yield key, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            key = int(values[a])
            held.append([c[a:b].copy() for c in columns])
    if key is not None:
        yield key, [np.concatenate(x) for x in zip(*held, strict=True)]


def _deltas(values: np.ndarray) -> bytes:
    import zstandard

    deltas = np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T  # bytes of one rank together
    return zstandard.ZstdCompressor(level=1).compress(deltas.tobytes())


def _small(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes())


def _gram_blobs(train: DataFrame, held, group: int) -> DataFrame:
    """``shard, contexts, keys, counts``: each task's pairs (no contexts) and triples (shards after the pairs') of a group, sorted and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        size = model.frequent + 2

        def take(rows: pa.Table, distinct: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, _, number, context = _contexts(model, distinct, tokens, lengths)
            ok = (number >= 0) & (context >= 0)
            keys, inverse, counts = np.unique(context[ok] * size + number[ok], return_inverse=True, return_counts=True)
            every = keys
            shard = model.shard_of(u := keys // size, keys - u * size)
            order = _order(shard, model.shards)
            out = [(s, None, _deltas(keys[at := order[a:b]]), _small(counts[at])) for s, a, b in _spans(shard[order])]
            if model.order > 2:
                at = _before(context, lengths)
                at = at[number[at] >= 0]
                pairs, row = _used(every, inverse[np.cumsum(ok)[at - 1] - 1])
                keys, counts = np.unique(row * size + number[at], return_counts=True)
                row = keys // size
                w = keys - row * size
                shard = model.triple_shard(pairs[row], model.way_of(model.ways(pairs)[row], w))
                order = _order(shard, model.triple_shards)
                for s, a, b in _spans(shard[order]):
                    at = order[a:b]
                    first = np.diff(row[at], prepend=-1) > 0
                    out.append((model.shards + s, _deltas(pairs[row[at][first]]), _deltas((np.cumsum(first) - 1) * size + w[at]), _small(counts[at])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "contexts", "keys", "counts"])

        yield from _grouped(batches, 0, take, group)

    return train.select("text").mapInArrow(run, "shard bigint, contexts binary, keys binary, counts binary")


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    return _values(keys), np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "<u4").astype(np.int64)


def _values(deltas: bytes) -> np.ndarray:
    import zstandard

    ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(deltas), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(ranks).view("<i8").ravel())


#: Entries that wait before they are added up, unless the sum so far is larger.
WAITING = 1 << 19


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")  # merges the sorted parts
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _merged_triples(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shard, contexts, keys (the context's place times ``size`` and the successor) and counts: the blobs of a shard added up, as they come."""
    none = (np.empty(0, np.int64),) * 3
    shard, sums, waiting, held = None, none, [], 0

    def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [x for x in (sums, *waiting) if len(x[0])]
        if not parts:
            return none
        contexts = _distinct(np.concatenate([x[0] for x in parts]))
        moved = []
        for c, k, _ in parts:
            k = k.copy()
            place = np.searchsorted(contexts, c)
            context = k // size
            k += (place[context] - context) * size
            moved.append(k)
        return contexts, *_added(np.concatenate(moved), np.concatenate([x[2] for x in parts]))

    for batch in batches:
        for s, c, k, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if shard is not None and s != shard:
                yield shard, *fold()
                sums, waiting, held = none, [], 0
            shard = s
            waiting.append((_values(c), *_unpacked(k, n)))
            held += len(waiting[-1][1])
            if held > max(WAITING, len(sums[1])):
                sums = fold()
                waiting, held = [], 0
    if shard is not None:
        yield shard, *fold()


def _merged_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, keys and counts: the blobs of a shard added up, as they come."""
    shard, keys, counts, waiting, held = None, np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return _added(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))

    for batch in batches:
        for s, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if shard is not None and s != shard:
                yield shard, *fold()
                keys, counts, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
            shard = s
            waiting.append(_unpacked(k, c))
            held += len(waiting[-1][0])
            if held > max(WAITING, len(keys)):
                keys, counts = fold()
                waiting, held = [], 0
    if shard is not None:
        yield shard, *fold()


def train_model(docs: DataFrame, min_count: int = MIN_COUNT, shard: int = SHARD, group: int = GROUP, least: int = 2, order: int = 2) -> Model:
    """The model of ``docs`` (column ``text``), its levels in the shared folder. ``order``: 2 or 3."""
    spark = common.prepare(docs.sparkSession)
    folder = common.shared_folder(spark, "trie")
    words = common.materialize(_count_words(docs, group), "lm-words")
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    bits = max(0, math.ceil(math.log2(max(1, v / shard))))
    model = Model(folder, n, v, bits, shard)
    model.order = order
    if not v:
        return model

    def word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (h, c) in _runs_of(batches):
            arrays = Words.arrays(h, c, min_count)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([save(folder, arrays)], pa.string()), pa.array([len(arrays["frequent"])], pa.int64())], names=["shard", "file", "n"])

    dealt = words.select(F.shiftright("h", 63 - bits).alias("shard") if bits else F.lit(0).cast("bigint").alias("shard"), "h", "c")
    dealt = dealt.repartition(1 << bits, "shard").sortWithinPartitions("shard", "h")
    for r in sorted(common.materialize(dealt.mapInArrow(word_files, "shard bigint, file string, n bigint"), "lm-level1").collect()):
        model.words[r["shard"]] = (r["file"], model.frequent)
        model.frequent += r["n"]

    # the second level: contexts that fill a shard alone have their successors dealt again
    limit = 2 * shard
    model.shards, model.triple_shards = max(1, -(-n // limit)), max(1, -(-2 * n // limit))
    texts = docs.count()
    hot = words.where((F.col("c") > limit // 4) & (F.col("h") != END)).select("h", "c").collect()  # at most 4 n / limit
    if hot:
        hashes = np.sort(np.asarray([r["h"] for r in hot], np.int64))
        counts, numbers = model.look_words(hashes)
        model.hot = {int(i): -(-int(c) * 4 // limit) + 1 for i, c in zip(numbers, counts, strict=True) if i >= 0}
    if texts > limit // 4:
        model.hot[model.frequent] = -(-texts * 4 // limit) + 1
    held = spark.sparkContext.broadcast(model)
    # pairs and triples are shuffled once, and lie nowhere but in the shuffle
    blobs = _gram_blobs(docs, held, group).repartition(model.shards + (model.triple_shards if order > 2 else 0), "shard").sortWithinPartitions("shard")
    size, before = model.frequent + 2, model.shards
    kinds = "shard bigint, ones bigint, twos bigint, keys binary, counts binary, file string"
    columns = to_arrow_schema(_parse_datatype_string(kinds))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, rest = iter(batches), []

        def pairs() -> Iterator[pa.RecordBatch]:  # their shards come first
            for batch in batches:
                n = int(np.searchsorted(batch.column(0).to_numpy(), before))
                if n:
                    yield batch.slice(0, n).select(["shard", "keys", "counts"])
                if n < batch.num_rows:
                    rest.append(batch.slice(n))
                    return

        def row(shard: int, counts: np.ndarray, *values) -> pa.RecordBatch:
            kept = [shard, int((counts == 1).sum()), int((counts == 2).sum()), *values]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(kept, columns, strict=True)], schema=columns)

        for part, keys, counts in _merged_blobs(pairs()):
            kept = counts >= least
            yield row(part, counts, _deltas(keys[kept]), _small(counts[kept]), None)
        for part, contexts, keys, counts in _merged_triples(itertools.chain(rest, batches), size):
            yield row(part - before, counts, None, None, save(folder, Triples.arrays(contexts, keys, counts, size)))

    every = common.materialize(blobs.mapInArrow(added, kinds), "lm-merged")
    built = every.where("file is not null").select("shard", "file", "ones", "twos").collect()
    model.triples = {r["shard"]: r["file"] for r in built}
    model.triple_discount = _discount(sum(r["ones"] for r in built), sum(r["twos"] for r in built))
    merged = every.where("file is null")
    seen = merged.agg(F.sum("ones").alias("a"), F.sum("twos").alias("b")).first()
    discount = _discount(seen["a"] or 0, seen["b"] or 0)

    # a context's count: a join of the shards' distinct contexts with the numbered words' counts
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of the contexts, read from the first level by number."""
        model = held.value
        starts = sorted((first, s) for s, (_, first) in model.words.items())
        firsts = np.asarray([x[0] for x in starts])
        for batch in batches:
            for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k, c = _unpacked(keys, counts)
                u, w = k // size, k % size
                total = np.full(len(u), float(texts))
                own = u < model.frequent
                for s, a, b in _spans(np.where(own, np.searchsorted(firsts, u, "right") - 1, len(firsts))):
                    if s == len(firsts):
                        continue
                    a_ = load(model.folder, model.words[starts[s][1]][0])
                    at = np.asarray(a_["frequent"][u[a:b] - starts[s][0]]).astype(np.int64)
                    code = np.asarray(a_["code"][at]).astype(np.int64)
                    big = code == 255
                    code[big] = a_["count"][np.searchsorted(a_["large"], at[big])]
                    total[a:b] = code
                codes = share_codes((c - discount) / total)
                kept = codes > 0
                u, w, codes = u[kept], w[kept], codes[kept]
                name = save(folder, Pairs.arrays(u, w, codes, size))
                x, where = np.unique(u, return_inverse=True)
                used = np.bincount(where, SHARES[codes], len(x)) if len(x) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array([part] + [None] * len(x), pa.int64()), pa.array([name] + [None] * len(x), pa.string()), pa.array([None, *x.tolist()], pa.int64()), pa.array([None, *used.tolist()], pa.float64())], names=["shard", "file", "u", "used"])

    built = common.materialize(merged.select("shard", "keys", "counts").repartition(model.shards, "shard").mapInArrow(contexts, "shard bigint, file string, u bigint, used double"), "lm-level2")
    for r in built.where("shard is not null").select("shard", "file").collect():
        model.pairs[r["shard"]] = r["file"]

    def rest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (u, used) in _runs_of(batches):
            rest = np.full(min(shard, held.value.frequent + 1 - part * shard), 65535, np.uint16)
            rest[u - part * shard] = np.floor(np.clip(1 - used, 0, 1) * 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([save(folder, {"rest": rest})], pa.string())], names=["part", "file"])

    used = built.where("u is not null").groupBy("u").agg(F.sum("used").alias("used"))
    used = used.select(F.floor(F.col("u") / shard).cast("bigint").alias("part"), "u", "used")
    used = used.repartition(max(1, model.frequent // shard + 1), "part").sortWithinPartitions("part")
    for r in common.materialize(used.mapInArrow(rest_files, "part bigint, file string"), "lm-rests").collect():
        model.rests[r["part"]] = r["file"]
    return model


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))


def score_texts(docs: DataFrame, model: Model, group: int = GROUP) -> DataFrame:
    """Adds ``n_tokens, n_known, base_score, score`` to the columns of ``docs`` but ``text``."""
    spark = common.prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("text", "n_tokens", "n_known", "base_score", "score")]
    own = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    schema = f"{own}n_tokens bigint, n_known bigint, base_score double, score double"

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value

        def take(rows: pa.Table, distinct: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
            count, numbers, number, context = _contexts(model, distinct, tokens, lengths)
            p1 = model.p1(count)
            p = p1[tokens]
            size = model.frequent + 2
            start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            ok = (context >= 0) & (number >= 0)
            every, inverse = np.unique(context[ok] * size + number[ok], return_inverse=True)
            if model.pairs:
                # of the distinct tokens, whose numbers are in order; the end's place stands for the begin
                numbers[-1] = model.frequent
                rests, own = np.ones(len(numbers)), np.flatnonzero(numbers >= 0)
                rests[own] = model.look_rests(numbers[own])
                before = np.append(tokens[-1:], tokens[:-1])  # a text's first token follows the end of another, as its begin
                p *= rests[before]
                u = every // size
                p[ok] += SHARES[model.look_pairs(u, every - u * size)][inverse]
            if model.triples:
                d = model.triple_discount
                at = _before(context, lengths)
                pairs, row = _used(every, inverse[np.cumsum(ok)[at - 1] - 1])
                keys, inverse = np.unique(row * (size + 1) + number[at] + 1, return_inverse=True)
                place = keys // (size + 1)
                successors, total, c = model.look_triples(pairs, place, keys - place * (size + 1) - 1)
                c, successors, total = c[inverse], successors[row], total[row]
                p[at] = np.where(total > 0, (np.maximum(c - d, 0) + d * successors * p[at]) / np.maximum(total, 1), p[at])
            known = np.add.reduceat((count > 0).astype(np.int64)[tokens], start)
            base, score = (np.add.reduceat(x, start) for x in (np.log10(np.maximum(p1, 1e-300))[tokens], np.log10(np.maximum(p, 1e-300))))
            columns = [c.combine_chunks().cast(t) for c, t in zip(rows.columns, out.types)]  # noqa: B905
            arrays = [*columns, *(pa.array(x, t) for x, t in zip((lengths, known, base, score), out.types[len(kept) :], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

        yield from _grouped(batches, len(kept), take, group)

    return docs.select(*[F.col(f"`{c}`") for c in kept], "text").mapInArrow(run, schema)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held_fold: int = 1,
    min_count: int = MIN_COUNT, shard: int = SHARD, group: int = GROUP, least: int = 2, order: int = 2,
) -> DataFrame:
    """``id, held_out, train_tokens`` and the scores of every row, by the model of the rows whose
    ``crc32`` of the id as text leaves another remainder than ``held_fold``."""
    fold = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (fold == held_fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    model = train_model(rows.where(~F.col("held_out")).select("text"), min_count, shard, group, least, order)
    return score_texts(rows, model, group).withColumn("train_tokens", F.lit(model.n).cast("bigint"))
