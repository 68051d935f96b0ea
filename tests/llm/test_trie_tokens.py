"""op8: a group's distinct words are hashed once, contexts are found by sorting, and only hot words are dealt again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import common, eftrie

TEXTS = ["  A b\x0bc\r\nb ", "", None, "ÄB äb\x85x y b", " \t", "b b b b b b b", "c"]


def _words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("group", [1, 5, 9, 100])
@pytest.mark.parametrize("size", [1, 3, 7])
def test_groups_hash_distinct_words_once(monkeypatch, group, size):
    hashed = []
    real = common.hash_words
    monkeypatch.setattr(common, "hash_words", lambda words: hashed.append(words) or real(words))
    whole = pa.table({"id": [0, 1, 2, None, 4, 5, 6], "text": TEXTS})
    got, groups = [], []

    def take(rows, distinct, tokens, lengths):
        assert (np.diff(distinct) > 0).all() and distinct[-1] == eftrie.END
        groups.append(lengths.tolist())
        for i, own in zip(rows["id"].to_pylist(), np.split(distinct[tokens], np.cumsum(lengths)[:-1]), strict=True):
            got.append((i, own.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([len(groups)])], names=["n"])

    out = list(eftrie._grouped(iter(whole.to_batches(max_chunksize=size)), 1, take, group))
    ends = [[*(int(h) >> 1 for h in real(_words(t))), eftrie.END] for t in TEXTS]
    assert got == list(zip([0, 1, 2, None, 4, 5, 6], ends, strict=True))
    assert all(len(words) == len(set(words)) for words in hashed) and len(hashed) == len(groups) == len(out)
    assert all(sum(x) >= group > sum(x[:-1]) for x in groups[:-1])  # the last row reaches the size, none before it


def test_texts_alone_have_no_other_columns():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a", None])], names=["text"])
    (out,) = eftrie._grouped(iter([batch, batch.slice(0, 0)]), 0, lambda rows, distinct, tokens, n: iter([(rows.num_columns, np.bincount(tokens).tolist(), n.tolist())]), 100)
    assert out[0] == 0 and sorted(out[1]) == [1, 2, 2] and out[2] == [4, 1]


def test_bits_of_all_widths():
    rng = np.random.default_rng(3)
    for width in range(1, 64):
        values = rng.integers(0, 1 << width, 200) if width < 63 else rng.integers(0, (1 << 63) - 1, 200)
        at = np.append(rng.integers(0, 200, 300), [0, 199])
        assert (eftrie.unpack_bits(eftrie.pack_bits(values, width), at, width) == values[at]).all()


def test_merged_contexts_are_sorted_not_hashed(monkeypatch):
    real = np.unique

    def unique(values, **options):
        assert any(options.values()), "numpy's hash table is a hundred times slower than sorting"
        return real(values, **options)

    monkeypatch.setattr(eftrie.np, "unique", unique)
    rows = []
    for contexts, keys, counts in (([3, 9], [5, 107, 108], [1, 2, 3]), ([9, 12], [7, 101], [4, 5])):
        rows.append((1, eftrie._deltas(np.array(contexts)), eftrie._deltas(np.array(keys)), eftrie._small(np.array(counts))))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], names=["shard", "contexts", "keys", "counts"])
    ((shard, contexts, keys, counts),) = eftrie._merged_triples(iter([batch]), 100)
    assert (shard, contexts.tolist(), keys.tolist(), counts.tolist()) == (1, [3, 9, 12], [5, 107, 108, 201], [1, 6, 3, 5])


def test_only_hot_words_are_dealt_again():
    model = eftrie.Model("", 1, 1, 0)
    model.frequent, model.shards, model.triple_shards, model.hot = 50, 7, 5, {3: 4, 10: 2, 49: 6, 50: 3}
    size = model.frequent + 2
    rng = np.random.default_rng(5)
    contexts = np.sort(rng.choice(size * size, 1500, replace=False))
    u, v = contexts // size, contexts % size
    ways = model.ways(contexts)
    assert ways.tolist() == [min(model.hot.get(a, 1), model.hot.get(b, 1)) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    key = [a + (((int(common.mix(np.array([b + 77], np.uint64))[0]) % model.hot[a] + 1) << 44) if a in model.hot else 0) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    assert model.shard_of(u, v).tolist() == [int(common.mix(np.array([k + 12345], np.uint64))[0]) % 7 for k in key]
    w = rng.integers(0, 50, len(contexts))
    assert model.way_of(ways, w).tolist() == [int(common.mix(np.array([x + 77], np.uint64))[0]) % n for x, n in zip(w.tolist(), ways.tolist(), strict=True)]
    assert ways.max() > 1
