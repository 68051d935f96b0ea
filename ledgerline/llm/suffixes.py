"""Repeated byte strings across documents, by a depth-limited radix sort of suffixes.

A window is a string of ``length`` bytes of one text (UTF-8). It is removed from a document if it
also starts in a document with a smaller id; overlapping windows count, and all are judged on
the input. Only suffixes of windows that may be shared are sorted:

0. **Copies.** Of rows with one text, those after the smallest id lose it whole; only the first take part below. Texts are
   grouped by digest, and a Bloom filter holds back the rows that meet their group.
1. **Anchors.** Each window has one anchor: the leftmost of its ``GRAM``-byte strings with the smallest
   hash. It depends on the window's bytes alone, so equal windows have equal anchors; a text has
   one anchor for about 14 bytes. Anchors are counted by hash (partial aggregates), and those
   of a single document go. Bloom filters carry the others to the tasks; a false positive costs time only.
2. **Slices.** The windows with one anchor position follow each other and lie in one slice of at most
   ``2 * length - GRAM`` bytes. Slices are dealt by anchor hash, so equal windows meet.
3. **Radix sort.** A task sorts the windows (suffixes of a slice, cut at ``length`` bytes) by anchor and anchor
   offset, then in most-significant-digit passes of eight bytes. After each pass, groups of a
   single document go. The groups left after the last pass are exactly the repeated windows;
   each keeps its smallest document id.
4. **Frequent anchors** (more than ``HOT`` places) may hold a third of all documents, so no task takes one whole:
   equal slices are first merged by a partial aggregate and the distinct ones sorted as above; an anchor with more than
   ``WIDE`` distinct slices is split into windows, grouped by all their digits at once. The groups' ids join back to
   the places by slice.
5. Removed spans are grouped by document and meet only the texts that have some.

Defined results: a null text is empty. Rows without an id come after all ids: they
lose what a document with an id has, and never cause a removal. Rows with one id do not remove from each
other. The id 2^63-1 counts as no id. Texts shorter than ``length`` bytes lose nothing. An empty table gives an empty
result. Input columns pass through; ``spans`` and ``kept`` replace input columns of these names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: ``GRAM`` is a multiple of eight.
LENGTH, GRAM = 50, 24
#: An anchor with more places than this is handled by aggregates instead of in one task.
HOT = 1024
#: An anchor with more distinct slices than this is split into windows.
WIDE = 32_768
#: Positions hashed at once (cache-sized), and slices sorted at once.
BLOCK, SLICES = 1 << 15, 60_000
NO_ID = (1 << 63) - 1

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as integers."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def anchors(data: np.ndarray, length: int):
    """``(anchor, hash)`` of the window at each position of ``data``; positions are those of ``data``."""
    n = len(data) - length + 1
    at, hashed = np.empty(n, np.int64), np.empty(n, np.uint64)
    mask = np.uint64((1 << 16) - 1)
    for a in range(0, n, BLOCK):
        part = data[a : min(a + BLOCK, n) + length - 1]
        v = _words(part).astype(np.uint64)
        size = len(part) - GRAM + 1
        h = np.zeros(size, np.uint64)
        for word in range(0, GRAM, 8):
            h ^= v[word : word + size]
            h *= _MUL
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = _sliding_min((h & ~mask) | np.arange(size, dtype=np.uint64), length - GRAM + 1)
        best = (low & mask).astype(np.int64)
        at[a : a + len(best)] = best + a
        hashed[a : a + len(best)] = h[best]
    return at, hashed


def places(texts: pa.Array, length: int):
    """The anchors of all texts: ``(row, first, last, anchor, hash)``, where windows ``first..last`` of the
    row have this anchor; positions count from the row's first byte. Also the bytes and the rows' starts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if len(data) < length:
        return none, data, offsets
    at, hashed = anchors(data, length)
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that lie within one row
    fits = sizes >= length
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - length + 1, -1)
    valid = np.cumsum(inside)[: len(at)] > 0
    new = np.empty(len(at), bool)
    new[0] = True
    # an anchor of one row is none of another: windows of different rows share no byte
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    new[offsets[:-1][offsets[:-1] < len(at)]] = True
    new[0::BLOCK] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    row = np.searchsorted(offsets, first, side="right") - 1
    base = offsets[row]
    return (row, first - base, last - base, at[first] - base, hashed[first]), data, offsets


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of ``data[start : start + size]``."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    index = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[index])])


def lowest(data: np.ndarray, start: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Most-significant-digit passes over the windows at ``start`` of ``data``: for each window the smallest ``lo``
    of the windows equal to it (with the same ``group``), or ``NO_ID`` where all have one id."""
    out = np.full(len(start), NO_ID, np.int64)
    alive = np.argsort(group, kind="stable")
    group = group[alive]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = _words(padded)
    for depth in range(0, length + 8, 8):
        if not len(alive):
            return out
        new = np.empty(len(alive), bool)
        new[0] = True
        new[1:] = group[1:] != group[:-1]
        if depth:  # order each group by its next digit
            digit = words[start[alive] + depth - 8].byteswap()
            if depth > length:
                digit >>= np.uint64(8 * (depth - length))
            order = np.lexsort((digit, group))
            alive, digit, group = alive[order], digit[order], group[order]
            new[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        bounds = np.flatnonzero(new)
        least, most = np.minimum.reduceat(lo[alive], bounds), np.maximum.reduceat(hi[alive], bounds)
        which = np.cumsum(new) - 1
        shared = (least < most)[which]
        alive, group = alive[shared], which[shared]
        if depth >= length:
            out[alive] = least[group]
    return out


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` a run 0, 1, ...: ``(owner, number)``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(owner: np.ndarray, number: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive hit numbers of one owner: ``(owner, first, last)``."""
    owner, number = owner[hit], number[hit]
    if not len(owner):
        return owner, number, number
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], number[first], number[np.append(first[1:], len(owner)) - 1]


SPAN = "doc bigint, mark bigint, first bigint, past bigint"


def _span_batch(doc, mark, first, past) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (doc, mark, first, past)], names=["doc", "mark", "first", "past"]
    )


def _gram(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashed anchors at these places (a collision only joins two groups of the sort)."""
    words = _words(data)
    h = np.zeros(len(at), np.uint64)
    for word in range(0, GRAM, 8):
        h = common.mix(h * _MUL + words[at + word])
    return h


def _sort_slices(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Removed spans of slices (whole anchor groups) by the radix sort."""
    encoded = rows.column("slice").combine_chunks().dictionary_encode()
    which = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = encoded.dictionary
    ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)
    doc = rows.column("doc").to_numpy()
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(distinct)))
    lo, hi = np.minimum.reduceat(doc[order], bounds), np.maximum.reduceat(doc[order], bounds)
    one = order[bounds]  # a row of each distinct slice; its hash and anchor follow from its bytes
    anchor = rows.column("anchor").to_numpy()[one].astype(np.int64)
    code = np.unique(_gram(data, ends[:-1] + anchor), return_inverse=True)[1]
    counts = np.diff(ends) - length + 1
    owner, number = _expand(counts)
    group = code[owner] * (2 * length) + (anchor[owner] - number)  # equal windows have equal anchor offsets
    least = lowest(data, ends[:-1][owner] + number, group, lo[owner], hi[owner], length)
    base = np.cumsum(counts) - counts
    place, at = _expand(counts[which])
    hit = least[base[which[place]] + at] < doc[place]
    place, first, last = _runs(place, at, hit)
    start = rows.column("start").to_numpy()[place]
    return _span_batch(doc[place], rows.column("mark").to_numpy()[place], start + first, start + last + length)


#: The anchor of a slice, which deals the slices.
GRAM_OF = f"substring(slice, anchor + 1, {GRAM})"
SLICE = "anchor int, slice binary, doc bigint, mark bigint, start bigint"


def removed_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc, mark, first, past)``: byte spans that repeated windows cover, of rows ``(doc bigint, mark bigint,
    text string)``, where ``doc`` orders the documents. Spans may overlap."""
    spark = texts.sparkSession

    def count(batches):
        for batch in batches:
            (row, _, _, _, code), _, _ = places(batch.column("text"), length)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(doc)], names=["code", "doc"])

    found = texts.mapInArrow(count, "code bigint, doc bigint")
    shared = found.groupBy("code").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    shared = common.materialize(shared.where("lo < hi").select("code", "n"), "shared-anchors")
    hot = shared.where(F.col("n") > HOT)
    n_shared, n_hot = shared.count(), hot.count()
    member, frequent = common.bloom(shared, "code", n_shared), common.bloom(hot, "code", n_hot)

    def cut(of_frequent: bool):
        def run(batches):
            for batch in batches:
                (row, first, last, anchor, code), data, offsets = places(batch.column("text"), length)
                code = code.view(np.int64)
                keep = np.flatnonzero(member.value.test(code))
                keep = keep[frequent.value.test(code[keep]) == of_frequent]
                doc = batch.column("doc").to_numpy(zero_copy_only=False)
                mark = batch.column("mark").to_numpy(zero_copy_only=False)
                for a in range(0, len(keep), SLICES):
                    k = keep[a : a + SLICES]
                    yield pa.RecordBatch.from_arrays([
                        pa.array((anchor - first)[k].astype(np.int32)),
                        _slices(data, offsets[row[k]] + first[k], (last - first)[k] + length),
                        pa.array(doc[row[k]]), pa.array(mark[row[k]]), pa.array(first[k]),
                    ], names=["anchor", "slice", "doc", "mark", "start"])

        return texts.mapInArrow(run, SLICE)

    spans = cut(False).repartition(F.expr(GRAM_OF)).sortWithinPartitions(F.expr(GRAM_OF))
    spans = spans.mapInArrow(lambda batches: _whole_anchors(batches, lambda rows: _sort_slices(rows, length)), SPAN)
    if n_hot:
        spans = spans.unionByName(_frequent(cut(True), length))
    return spans


FOUND = "slice binary, found array<struct<number:int,least:bigint>>"


def _sort_distinct(rows: pa.Table, length: int) -> pa.RecordBatch:
    """For each distinct slice (whole anchor groups) the windows that a smaller document has, and its id."""
    column = rows.column("slice").combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    anchor = rows.column("anchor").to_numpy().astype(np.int64)
    code = np.unique(_gram(data, ends[:-1] + anchor), return_inverse=True)[1]
    owner, number = _expand(np.diff(ends) - length + 1)
    lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
    least = lowest(data, ends[:-1][owner] + number, code[owner] * (2 * length) + (anchor[owner] - number), lo[owner], hi[owner], length)
    hit = least < hi[owner]
    some, size = np.unique(owner[hit], return_counts=True)
    found = pa.StructArray.from_arrays([pa.array(number[hit].astype(np.int32)), pa.array(least[hit])], names=["number", "least"])
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([column.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(bounds), found)], names=["slice", "found"])


def _whole_anchors(batches, work):
    """``work`` on portions of rows sorted by anchor, none of which parts the rows of one anchor."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SLICES:
            rows = pa.Table.from_batches(held)
            column = rows.column("slice").combine_chunks()
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + size]
            code = _gram(np.frombuffer(column.buffers()[2], np.uint8), ends + rows.column("anchor").to_numpy())
            other = np.flatnonzero(code != code[-1])  # the last anchor may go on in the next batch
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield work(rows.slice(0, end))
            held = rows.slice(end).combine_chunks().to_batches()
            size -= end
    if size:
        yield work(pa.Table.from_batches(held))


def _frequent(slices: DataFrame, length: int) -> DataFrame:
    """Removed spans of the slices of frequent anchors: equal slices are merged by a partial aggregate before an anchor's
    distinct slices meet; an anchor with many of these is split into windows, grouped by all their bytes."""
    sid = F.substring(F.unhex(F.sha2("slice", 256)), 1, 16)
    slices = common.materialize(slices, "frequent-slices")
    distinct = slices.groupBy("slice").agg(F.first("anchor").alias("anchor"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    distinct = common.materialize(distinct.withColumn("gram", F.xxhash64(F.expr(GRAM_OF))), "distinct-slices")
    wide = common.materialize(distinct.groupBy("gram").count().where(F.col("count") > WIDE).select("gram"), "wide-anchors")
    n_wide = wide.count()
    if n_wide:
        is_wide = _member(wide, "gram")
        narrow, wide = distinct.where(~is_wide("gram")), distinct.where(is_wide("gram"))
    else:
        narrow = distinct
    found = narrow.drop("gram").repartition(F.expr(GRAM_OF)).sortWithinPartitions(F.expr(GRAM_OF))
    found = found.mapInArrow(lambda batches: _whole_anchors(batches, lambda rows: _sort_distinct(rows, length)), FOUND)
    if n_wide:
        numbers = F.sequence(F.lit(0), F.length("slice") - length)
        windows = wide.select("lo", "hi", "slice", F.explode(numbers).alias("number"))
        windows = windows.withColumn("window", F.expr(f"substring(slice, number + 1, {length})"))
        groups = windows.groupBy("window").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
        groups = groups.where("least < most").select("window", "least")
        back = windows.select("slice", "number", "window").join(groups, "window").groupBy("slice")
        found = found.unionByName(back.agg(F.sort_array(F.collect_list(F.struct("number", "least"))).alias("found")))
    met = slices.select(sid.alias("sid"), "doc", "mark", "start").join(found.select(sid.alias("sid"), "found"), "sid")

    def run(batches):
        for batch in batches:
            found = batch.column("found")
            size = np.asarray(found.value_lengths())
            flat = found.flatten()
            owner, _ = _expand(size)
            doc = batch.column("doc").to_numpy()
            place, first, last = _runs(owner, flat.field("number").to_numpy().astype(np.int64), flat.field("least").to_numpy() < doc[owner])
            start = batch.column("start").to_numpy()[place]
            yield _span_batch(doc[place], batch.column("mark").to_numpy()[place], start + first, start + last + length)

    return met.select("doc", "mark", "start", "found").mapInArrow(run, SPAN)


def merge(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; spans that touch are one run."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(past[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:], len(first)) - 1]


def _member(of: DataFrame, column: str):
    """A test of bigint columns against a Bloom filter of ``of``; only that column goes to Python."""
    member = common.bloom(of, column, of.count())

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(member.value.test(values.to_numpy()))

    return test


def _copies(rows: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """The rows ``(row, doc, mark)`` without later copies of a text, and those copies. In the first part
    ``mark`` is 0 unless the id may stand at several texts: the spans that are shuffled bear the id alone."""
    alike = rows.select("mark", "doc", F.sha2(text, 256).alias("sid")).groupBy("mark", "sid").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most")
    )
    alike = common.materialize(alike.where("least < most"), "copies")
    copied = _member(alike, "mark")
    maybe = rows.where(copied("mark")).withColumn("sid", F.sha2(text, 256)).join(alike.select("sid", "least"), "sid", "left")
    maybe = common.materialize(maybe.drop("sid"), "maybe-copies")
    firsts = rows.where(~copied("mark")).unionByName(maybe.where("least IS NULL OR doc <= least").select("row", "doc", "mark"))
    twice = rows.groupBy("doc").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("doc")
    several = _member(common.materialize(twice, "ids-of-several-texts"), "doc")
    firsts = firsts.withColumn("mark", F.when(several("doc"), F.col("mark")).otherwise(F.lit(0).cast("bigint")))
    return firsts, maybe.where("doc > least").select("row", "doc", "mark")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with ``spans`` (array of ``(start, end)`` in bytes, maximal removed runs in order) and ``kept`` (binary,
    the remaining bytes; cuts may fall inside a character)."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    common.prepare(docs.sparkSession)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("doc"),
    )
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    rows = rows.withColumn("mark", F.xxhash64(text))
    firsts, copies = _copies(rows, text)
    spans = removed_spans(firsts.select("doc", "mark", text.alias("text")), length)
    found = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "past")).alias("found"))
    found = common.materialize(found, "removed-spans")
    hit = _member(found, "doc")

    def take(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found")):
                if not found.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                flat = found.values
                first, past = merge(flat.field("first").to_numpy(), flat.field("past").to_numpy())
                spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), past.tolist())])
                edge = [0, *np.stack([first, past], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["row", "spans", "kept"]
            )

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    cut = firsts.where(hit("doc")).join(found, ["doc", "mark"], "left").select("row", text.alias("text"), "found").mapInArrow(take, schema)
    none, size = F.array().cast(T.ArrayType(span)), F.octet_length(text).cast("bigint")
    whole = firsts.where(~hit("doc")).select("row", none.alias("spans"), text.cast("binary").alias("kept"))
    gone = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end")))
    later = copies.select(
        "row", F.when(size >= length, gone).otherwise(none).alias("spans"),
        F.when(size >= length, F.lit(b"")).otherwise(text.cast("binary")).alias("kept"),
    )
    out = cut.unionByName(whole).unionByName(later)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("spans", "kept")]
    return out.select(*own, "spans", "kept")
