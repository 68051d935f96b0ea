"""op8: places of bits by whole words, each context looked up once, n-grams shuffled once and written nowhere else."""

from __future__ import annotations

import numpy as np

from ledgerline.llm import common, eftrie


def test_nth_bits_and_steps():
    rng = np.random.default_rng(4)
    words = np.concatenate((rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2), rng.integers(0, 256, 50, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
    for n in (0, 1, 5, 31, 63, 64, 100):
        want = [([i for i in range(64) if int(w) >> i & 1] + [64] * 128)[n] for w in words]
        assert eftrie._nth_bits(words, np.full(len(words), n, np.int64)).tolist() == want
    for gap in (2, 60, 100_000):  # dense, and far apart
        values = np.cumsum(rng.integers(1, gap, 500) * rng.choice([1, 1, 1, 900], 500))
        coded = eftrie.EliasFano.encode(values)
        assert coded.steps(np.arange(499)).tolist() == np.diff(values).tolist()
        assert coded.find(values).tolist() == list(range(500))
        others = np.setdiff1d(rng.integers(0, int(values[-1]) * 2, 2000), values)
        assert (coded.find(others) == -1).all()


def test_a_context_is_looked_up_once(monkeypatch):
    asked = []
    find = eftrie.EliasFano.find
    monkeypatch.setattr(eftrie.EliasFano, "find", lambda self, values: asked.append(len(values)) or find(self, values))
    u, v = np.repeat(np.arange(10), 20), np.tile(np.arange(20), 10)
    level = eftrie.Pairs(eftrie.Pairs.arrays(u, v, np.arange(200, dtype=np.uint8), 30))
    assert level.look(u, v).tolist() == list(range(200))
    assert asked == [10, 200]


def test_ngrams_lie_in_one_shuffle(spark, monkeypatch):
    names = []
    real = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: names.append((name, df.columns)) or real(df, name))
    docs = spark.createDataFrame([("a b c a b",), ("b c a",), (None,)], "text string")
    model = eftrie.train_model(docs, min_count=1, least=1, order=3)
    assert model.pairs and model.triples
    assert not [n for n, columns in names if "contexts" in columns]  # the tasks' packed n-grams are no table


def test_distinct_values_in_order():
    for values in ([], [3], [5, 1, 5, 1, 2, 2]):
        assert eftrie._distinct(np.array(values, np.int64)).tolist() == sorted(set(values))
