from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import prefixtrie, queries


def brute(convs):
    """The nodes of ``{conv: [(role, text), ..]}``, from a dictionary of all prefixes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        leaves[p] = sum(leaves[k] for k in below) or 1
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    """The contract's conversations of ``(conv, turn, role, text)`` rows."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1], digest(x[2], x[3])))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for c in [*range(0, 60), *range(95, 130), 250, 300, 301, 377, -5, -100, 7_000_000_012]:
        n = rng.choice([0, 1, 1, 2, 4, 7, 12])
        say = lambda k: (rng.choice(["user", "bot", None]) if rng.random() < 0.1 else ["user", "bot"][k % 2], rng.choice(["hi", "no", "é漢", "", None, "ok then"]))
        turns = [(c, None if rng.random() < 0.05 else k // rng.choice([1, 1, 2]), *say(k)) for k in range(n)]
        out += turns
    for c in range(400, 470):  # many equal conversations, and prefixes of them
        out += [(c, k, "user", f"same {k}") for k in range(4 if c % 3 else 2)]
    out += [(500, k, "u", "long") for k in range(60)] + [(600, 0, "a", "bc"), (601, 0, "ab", "c"), (602, 0, "a", "b"), (602, 1, "", "c")]
    out += [(603, 5, "user", "twice"), (603, 5, "user", "twice"), (None, 1, "user", "lost"), (None, None, None, None), (604, None, None, None)]
    rng.shuffle(out)
    return out


def nodes(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("turns, piece, border", [(300_000, 8192, 100_000), (25, 3, 100_000), (6, 1, 0)])
def test_query_against_brute_force(spark, rows, tmp_path, monkeypatch, turns, piece, border):
    monkeypatch.setattr(prefixtrie, "CHUNK_TURNS", turns)
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    monkeypatch.setattr(prefixtrie, "BORDER_ROWS", border)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("seq", F.lit(1))
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(rebuilt(rows))
    assert nodes(queries.op12_conversation_trie(spark, str(tmp_path))) == want
    assert len(want) > 200


def test_plain_trie_and_empty_tables(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "b", "bb"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "bb")]
    frame = spark.createDataFrame(rows, "c long, n int, who string, what string")
    seqs = prefixtrie.sequences(frame, "c", "n", "who", "what")
    assert nodes(prefixtrie.trie(seqs)) == brute({1: [("u", "a"), ("b", "bb")], 2: [("u", "a")], 3: [("u", "a"), ("b", "bb")]})
    assert prefixtrie.trie(seqs.limit(0)).count() == 0
    turnless = seqs.where("conv = 1").withColumn("turns", F.slice("turns", 1, 0))
    assert nodes(prefixtrie.trie(turnless)) == brute({1: []})


def test_extents_against_scans():
    rng = random.Random(3)
    for n in (1, 2, 3, 8, 33, 100):
        lcp = np.asarray([-1] + [rng.randrange(6) for _ in range(n - 1)])
        table = prefixtrie._range_minima(lcp)
        row = np.repeat(np.arange(n), 7)
        depth = np.tile(np.arange(7), n)
        left, right = prefixtrie.left_extent(table, row, depth), prefixtrie.right_extent(table, row, depth)
        for i, d, a, b in zip(row.tolist(), depth.tolist(), left.tolist(), right.tolist()):
            x = i
            while x > 0 and lcp[x] >= d:
                x -= 1
            y = i
            while y + 1 < n and lcp[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)
