from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import suffixes


def brute(rows, length=50):
    """Spans and remaining bytes of ``(id, text)`` rows, from the windows' first documents."""
    big = float("inf")
    first = {}
    raw = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, big), i)
    out = []
    for (i, b), (own, _) in zip(raw, rows):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2])]
        out.append((own, spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(8)
    out = list(texts[:130])
    passage = "".join(rng.choices("abc é漢", k=70))
    for i in range(200, 240):  # one passage in many contexts, copies at every place, low entropy
        cut = passage[rng.randint(0, 30) : rng.randint(40, 70)]
        out.append((i, "".join(rng.choices("xyz ", k=rng.randint(0, 90))) + cut + "".join(rng.choices("xyz ", k=rng.randint(0, 90)))))
    out += [(240, "a" * 300), (241, "b" + "a" * 120 + "c"), (242, "ab" * 90), (243, "ba" * 40), (244, " " * 49), (245, " " * 50), (246, " " * 51)]
    out += [(241, "a" * 60), (None, "a" * 80 + "q" * 60), (None, "q" * 70), (300, "q" * 55), (301, "z" * 49), (302, "z" * 49), ((1 << 63) - 1, passage)]
    return out


@pytest.mark.parametrize("hot, wide", [(4096, 4096), (3, 4096), (3, 3)])
def test_against_brute_force(spark, rows, monkeypatch, hot, wide):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "WIDE", wide)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute([((None if i == suffixes.NO_ID else i), t) for i, t in rows])
    got = [((None if i == suffixes.NO_ID else i), s, k) for i, s, k in result(suffixes.dedup(docs))]
    assert sorted(got, key=str) == want
    assert sum(bool(s) for _, s, _ in want) > 60


def test_other_length_and_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    monkeypatch.setattr(suffixes, "SLICES", 7)
    some = [r for r in rows if r[0] != suffixes.NO_ID and len(r[1] or "") < 2000]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    assert result(suffixes.dedup(docs, length=37)) == brute(some, 37)


def test_columns_pass_and_may_clash(spark):
    long = "the same words stand in both documents, more than fifty bytes of them"
    docs = spark.createDataFrame(
        [(1, long, "r1", 1.5, "k", 3, None), (2, "x " + long, "r2", None, None, 4, "f")],
        "doc_id int, text string, row string, doc double, mark string, found int, spans string",
    )
    got = {r["doc_id"]: r for r in suffixes.dedup(docs).collect()}
    assert [(got[i]["row"], got[i]["doc"], got[i]["mark"], got[i]["found"]) for i in (1, 2)] == [("r1", 1.5, "k", 3), ("r2", None, None, 4)]
    assert bytes(got[2]["kept"]) == b"x " and bytes(got[1]["kept"]) == long.encode() and got[1]["spans"] == []


def test_empty_table_and_short_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a" * 49), (4, "a" * 49)], "doc_id long, text string")
    assert all(r["spans"] == [] for r in suffixes.dedup(docs).collect())
    assert suffixes.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.dedup(docs, length=20)


def test_radix_passes_find_equal_windows():
    rng = random.Random(1)
    data = np.frombuffer("".join(rng.choices("ab", k=3000)).encode(), np.uint8)
    start = np.arange(len(data) - 32)
    doc = np.asarray([rng.randrange(9) for _ in start], np.int64)
    for length in (9, 16, 19):
        least = suffixes.lowest(data, start, np.zeros(len(start), np.int64), doc, doc, length)
        groups = {}
        for p in start:
            groups.setdefault(bytes(data[p : p + length]), []).append(doc[p])
        for p in start:
            g = groups[bytes(data[p : p + length])]
            assert least[p] == (min(g) if min(g) < max(g) else suffixes.NO_ID)
