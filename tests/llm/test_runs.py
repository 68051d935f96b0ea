from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import queries, runs


def brute_runs(w, least=12):
    """Maximal stretches with smallest period q, from all periods."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(least, 2 * q):
                    out.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((a, size, q) for (a, size), q in out.items())


def brute_row(doc, text):
    """The registered query's row, by the contract's words."""
    w = (text or "").encode().split()
    n = len(w)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_words(rng):
    n, k = rng.randint(0, 130), rng.choice([1, 2, 3, 10])
    t = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        t = [t[i if i < a else a + (i - a) % p] for i in range(n)]
    return t


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_against_brute_force(least, monkeypatch):
    rng = random.Random(least)
    for round_ in range(50):
        monkeypatch.setattr(runs, "CANDIDATES", rng.choice([10, 1_000_000]))
        texts = [random_words(rng) for _ in range(rng.randint(1, 8))]
        text, *found = runs.find_runs([np.asarray(t, np.int64) for t in texts], least)
        for k, t in enumerate(texts):
            mine = text == k
            assert sorted(zip(*(x[mine].tolist() for x in found))) == brute_runs(t, least)


def test_extensions_against_direct_comparison():
    rng = random.Random(2)
    base = [rng.randrange(3) for _ in range(60)]
    words = base * 5 + [0] * 200 + base * 3 + [rng.randrange(2) for _ in range(400)] + [1, 0] * 80 + [9]
    w = np.asarray(words, np.int64)
    closed = np.zeros(len(w), bool)
    closed[-1] = True
    grammar = runs.Grammar(w, closed)
    assert len(grammar.levels) > 8 and len(grammar.levels[-1].start) < len(w) / 10
    for level in grammar.levels:  # each level spells the words
        assert level.start[0] == 0 and level.width.sum() == len(w)
        spelt = {}
        for s, x, size in zip(level.start, level.symbol, level.width):
            assert spelt.setdefault(x, tuple(words[s : s + size])) == tuple(words[s : s + size])
    pairs = np.asarray([sorted(rng.sample(range(len(w) - 1), 2)) for _ in range(4000)])
    i, j = pairs[:, 0], pairs[:, 1]

    def direct(a, b, way):
        n = 0
        while 0 <= a < b < len(words) and words[a] == words[b]:
            a, b, n = a + way, b + way, n + 1
        return n

    assert grammar.extend(i, j).tolist() == [direct(a, b, 1) for a, b in pairs.tolist()]
    assert grammar.extend_back(i, j).tolist() == [direct(a - 1, b - 1, -1) for a, b in pairs.tolist()]


def test_a_long_periodic_text_takes_few_steps():
    n = 300_000
    rng = np.random.default_rng(1)
    for texts, want in (
        ([np.zeros(n, np.int64)], [(0, n, 1)]),
        ([np.concatenate([rng.integers(5, 9_000_000, 40_000), np.tile(np.arange(1000), 60), rng.integers(5, 9_000_000, 40_000)])], None),
    ):
        _, *found = runs.find_runs(texts)
        found = list(zip(*(x.tolist() for x in found)))
        if want:
            assert found == want
        else:
            assert (40_000, 60_000, 1000) in found and len(found) == 1


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(6)
    out = [(i, t) for i, t in texts if len(t or "") < 4000]
    for i in range(300, 400):
        words = [rng.choice(["a", "b", "é", "漢字", "x y", "c "]) for _ in range(rng.randint(0, 60))]
        out.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words * rng.choice([1, 3])) + rng.choice(["", " "])))
    return out + [(500, "la " * 30), (501, "la " * 11), (502, "la " * 12), (500, "la " * 30), (-7, "no " * 40), (None, "so " * 40)]


def test_query_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 40


def test_columns_empty_tables_and_small_portions(spark, rows, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 20)
    docs = spark.createDataFrame([(i, t, "mine", 2.5, i) for i, t in rows], "doc_id int, text string, id string, runs double, row int")
    got = runs.detect(docs).collect()
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]]) for r in got) == sorted((str(i), brute_runs((t or "").encode().split())) for i, t in rows)
    assert all(r["id"] == "mine" and r["row"] == r["doc_id"] for r in got)
    assert all(r["n_words"] == len((r["text"] or "").encode().split()) for r in got)
    assert runs.detect(docs.limit(0)).count() == 0
