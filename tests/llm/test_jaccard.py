from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import common, jaccard


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        words = text.encode().lower().split() if text else []
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    first = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            up[find(i)] = find(first.setdefault(doc, i))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), names.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "num", "block", "family"), [(3, 90, 256, 2_000_000), (5, 80, 8, 100)])
def test_components_against_brute_force(spark, documents, texts, n, num, block, family):
    docs = documents.withColumnRenamed("doc_id", "own").selectExpr("own", "text", "1 as id", "'x' as digest", "2 as class")
    got = jaccard.link(docs, id_col="own", n=n, num=num, block=block, family=family).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(texts, n, num, 100)


def test_empty_table(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _families(rng):
    arrays = []
    for _ in range(rng.randint(1, 6)):
        base = np.unique([rng.randrange(1 << 62) for _ in range(rng.choice([1, 3, 10, 60, 200]))])
        for _ in range(rng.randint(1, 12)):
            x = set(base.tolist())
            for _ in range(rng.randint(0, len(base) // 8)):
                x.discard(rng.choice(base.tolist()))
                x.add(rng.randrange(1 << 62))
            arrays.append(np.array(sorted(x), dtype=np.int64))
    return arrays


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2), (1, 1)])
def test_trie_and_signatures_lose_no_link(num, den):
    rng = random.Random(num)
    for _ in range(25):
        arrays = _families(rng)
        links = [(i, j) for i, x in enumerate(arrays) for j, y in enumerate(arrays[:i]) if den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y))]
        every = np.concatenate(arrays)
        for heavy in (None, np.unique(rng.choices(every.tolist(), k=len(every) // 2)), np.unique(every)):
            signatures = jaccard.Signatures(num, den, heavy)
            signed = [set(signatures.of(x).tolist()) for x in arrays]
            for i, j in links:
                assert signed[i] & signed[j]
        half = len(arrays) // 2
        found = {(i, j) for i, j in jaccard.linked(arrays[:half], arrays[half:], num, den) if i != j}
        assert found == {(i, j) for a, b in links for i, j in ((a, b), (b, a)) if j < half}
        joined = jaccard.Links(list(range(len(arrays))))
        for a, b in jaccard.link_block(arrays, num, den):
            joined.join(a, b)
        for i, j in links:
            assert joined.find(i) == joined.find(j)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (300, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(200, 260)}, 5: 5, 300: 5}
