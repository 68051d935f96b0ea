from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from ledgerline.llm import packing
from ledgerline.llm.queries import vocabulary


def test_pieces_and_places(spark, documents, texts):
    rows = packing.pack(documents, keep_ids=True, **vocabulary()).collect()
    slow = Tokenizer.from_file(vocabulary()["vocabulary"])
    want = defaultdict(int)
    for doc, text in texts:
        ids = np.asarray(slow.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        start, end = 0, len(ids) % 1024 or 1024
        piece = 0
        while start < len(ids):
            part = ids[start:end].tobytes()
            want[doc, piece, start, end - start, zlib.crc32(part), part] += 1
            start, end, piece = end, end + 1024, piece + 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.05 + 2
    made = {r["sequence_id"]: r for r in packing.sequences(packing.pack(documents, keep_ids=True, **vocabulary())).collect()}
    assert sum(r["length"] for r in made.values()) == total
    assert all(len(r["ids"]) == 4 * r["length"] for r in made.values())


def test_encoder_is_the_tokenizer():
    encoder = packing.Encoder(**vocabulary())
    slow = Tokenizer.from_file(vocabulary()["vocabulary"])
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "漢", " ", "  ", "\n", "\n\n", "\r\n", "\t", "'s", "7", "!", " ", "<|endoftext|>", "word", " "]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_fullest_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.randint(1, 40)
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        chosen = packing.fullest(counts, room)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        assert sum(chosen) == max(sums)
        assert all(chosen.count(k) <= n for k, n in counts.items())


def test_plan_uses_every_piece():
    rng = random.Random(2)
    histogram = {n: rng.randint(0, 500) for n in range(1, 200)}
    used = defaultdict(int)
    for times, lengths in packing.plan_bins(histogram, 199):
        assert sum(lengths) <= 199
        for x in lengths:
            used[x] += times
    assert dict(used) == {k: v for k, v in histogram.items() if v}


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, piece string, length string, task string, sequence_id string"
    assert packing.pack(spark.createDataFrame([], schema), **vocabulary()).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a b", "x", "y", "z", "s")], schema), **vocabulary()).collect()
    assert [(r["id"], r["piece"], r["offset"]) for r in rows] == [(1, 0, 0)]
