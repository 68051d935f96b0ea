"""pipeline, op4: the work on a family of sets that share signatures grows with its links, not with its pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import jaccard


def _copies(rng, n, size, most):
    """Copies of one set with up to ``most`` of its shingles replaced."""
    base = rng.choice(1 << 40, size, replace=False)
    out = []
    for _ in range(n):
        x = base.copy()
        x[rng.choice(size, rng.integers(0, most + 1), replace=False)] = rng.integers(1 << 41, 1 << 61, 1)
        out.append(np.unique(x))
    return [np.unique(np.concatenate((x[: len(x) - k], rng.integers(1 << 41, 1 << 61, k)))) for x, k in zip(out, rng.integers(0, most + 1, n).tolist(), strict=True)]


def _linked(x, y, num, den):
    return den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y))


def test_sets_that_share_too_little_leave_before_the_walk():
    rng = np.random.default_rng(1)
    near = _copies(rng, 30, 100, 4)
    base = near[0]
    far = [np.unique(np.concatenate((base[:70], rng.integers(1 << 41, 1 << 61, 30)))) for _ in range(200)]
    pair = rng.integers(1 << 41, 1 << 61, 100)
    chain = [np.unique(pair), np.unique(np.concatenate((pair[:79], rng.integers(1 << 41, 1 << 61, 21))))]  # go with each other
    numbers, places, universe = jaccard._sharing([*far, *near, *chain], 80, 100)
    assert set(numbers) == set(range(200, 230))
    assert universe <= 200 and len(places) == 30
    for i, p in zip(numbers, places, strict=True):
        assert (np.diff(p) > 0).all() and len(p) <= len(near[i - 200])


def test_connected_sets_are_not_compared_again():
    near = _copies(np.random.default_rng(2), 300, 200, 8)
    links, pairs = jaccard.Links(list(range(300))), 0
    for i, j in jaccard.linked(near, [], 80, 100, links):
        links.join(i, j)
        pairs += 1
    assert links.parts == 1
    assert pairs < 20 * 300  # of 90,000


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_blocks_and_guests_against_all_pairs(monkeypatch, num, den):
    rng, pick = np.random.default_rng(num), random.Random(num)
    for run in range(40):
        monkeypatch.setattr(jaccard, "_RUN", [2, 64][run % 2])
        monkeypatch.setattr(jaccard, "_CELLS", [50, 1 << 20][run % 3 > 0])
        sets = [x for _ in range(3) for x in _copies(rng, pick.randint(1, 14), pick.choice([1, 5, 40, 150]), 0)]
        sets += [x for s in (10, 60, 150) for x in _copies(rng, 12, s, s // 6)]
        pick.shuffle(sets)
        half = len(sets) // 2
        groups = [pick.randrange(3 * len(sets)) for _ in sets]
        for met in (False, True):
            want, got = jaccard.Links(groups), jaccard.Links(groups)
            for i, x in enumerate(sets):
                for j, y in enumerate(sets[: half if i >= half else i]):
                    if (i >= half or not met) and _linked(x, y, num, den):
                        want.join(i, j)
            for i, j in jaccard.link_block(sets[:half], num, den, sets[half:], groups, met):
                assert got.join(i, j) and _linked(sets[i], sets[j], num, den)
            n = range(len(sets))
            assert len({(want.find(i), got.find(i)) for i in n}) == want.parts == got.parts


def test_a_large_family_in_blocks(spark):
    """Near copies, some of them too far from all others, in a family of many blocks, with guests in small batches."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = base.copy()
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 4, 7])):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=5, num=80, block=3, family=1000)
    sets = [jaccard.ordered_set(t, 5) for _, t in rows]
    links = jaccard.Links(list(range(90)))
    for i, x in enumerate(sets):
        for j in range(i):
            if _linked(x, sets[j], 80, 100):
                links.join(i, j)
    assert links.parts > 5
    assert sorted((r["id"], r["component_id"]) for r in got.collect()) == [(i, links.find(i)) for i in range(90)]
