from __future__ import annotations

import random
import re

import pytest

from ledgerline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        words = lowered(text)
        hit, found = set(), set()
        for item, item_text in items:
            w = lowered(item_text)
            size = min(13, len(w))
            windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add("null" if item is None else str(item))
        out.append((doc, len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(9)
    vocab = [f"x{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, prose(rng.choice([1, 5, 6, 12, 13, 14, 40, 90]))) for i in range(25)]
    items += [(100, None), (101, "..."), (3, items[3][1]), (102, items[4][1]), (None, prose(20)), (103, "Ünï Ça 漢字 é1")]
    docs = [(i, prose(rng.choice([0, 3, 50, 300]))) for i in range(30)]
    for i in range(30, 70):
        words = items[rng.randrange(25)][1].split()
        a = rng.randrange(len(words))
        cut = words[a : a + rng.choice([5, 12, 13, 30])]
        docs.append((i, f"{prose(rng.randint(0, 30))}, {'; '.join(cut).upper()} {prose(rng.randint(0, 200))}"))
    docs += [(80, None), (81, ""), (82, items[-2][1]), (83, "ünï ÇA 漢字 É1 Ünï ça 漢字 é1"), (5, docs[5][1]), (None, items[6][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_against_brute_force(spark, planted, block_words):
    docs, items = planted
    d = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    got = decontaminate.decontaminate(d, b, block_words=block_words).collect()
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got]
    assert sorted(rows, key=str) == brute(docs, items)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    assert sum(r["contaminated"] for r in got) > 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.decontaminate(docs, none).collect()[0]
    assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"]) == (2, 0, [], False)
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_winnowing_misses_no_window():
    rng = random.Random(4)
    import numpy as np

    for _ in range(200):
        grams = np.asarray([rng.randrange(5) for _ in range(rng.randint(8, 30))], dtype=np.uint64)
        at = set(decontaminate.winnow(grams, 8).tolist())
        for i in range(len(grams) - 7):
            run = grams[i : i + 8]
            assert any(j in at and grams[j] == run.min() for j in range(i, i + 8))
