"""Top-k search, language-model scoring and the quality classifier."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import eftrie, knmodel, topk


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 16)) * rng.choice([0.1, 1, 5], size=(700, 1))
    vectors[400:420] = vectors[5]  # ties
    rows = [(int(i), [float(np.float32(x)) for x in v], "clash") for i, v in enumerate(vectors)]
    rows += [(800, None, "a"), (900, [1.0, None], "a"), (1000, [float("nan")] * 16, "a"), (1100, [float("inf")] * 16, "a"), (None, [1.0] * 16, "a"), (300, [float(x) for x in np.float32(vectors[300])], "again"), (-100, [0.5] * 3, "short"), (1200, [], "none")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string").repartition(4)
    got = Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in topk.top_k(df, bucket_rows=64, block_rows=3).collect())
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (i, q) in enumerate(kept):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(kept) if m != n)
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:10]))
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_bucket_search_prunes_nothing_that_counts():
    rng = np.random.default_rng(8)
    for _ in range(60):
        m = rng.integers(-1000, 1000, size=(80, 6))
        m[::7] *= 3
        bucket = topk.Bucket(np.arange(80), m)
        q = m[rng.integers(80)] + rng.integers(-50, 50, 6)
        scores = sorted(((int(s), i) for i, s in enumerate(m @ q)), key=lambda e: (-e[0], e[1]))
        floor = scores[rng.integers(1, 20)][0]
        assert bucket.search(-1, q, 5, float(floor)) == [e for e in scores[:5] if e[0] >= floor]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 5), (1000, 1 << 62), (5000, 6000), (3000, 100_000), (2, 1 << 62), (100, 100)):
        values = np.unique(rng.integers(0, top, n))
        coded = eftrie.EliasFano.encode(values)
        assert coded.values().tolist() == values.tolist()
        asked = np.concatenate((values, rng.integers(0, top, 300), [0, top - 1, 1 << 62]))
        place = {int(x): i for i, x in enumerate(values)}
        assert coded.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


@pytest.mark.parametrize(("shard", "group"), [(1 << 20, 1 << 20), (64, 500)])
def test_lm_scores(spark, documents, texts, shard, group):
    got = eftrie.score(documents.selectExpr("doc_id", "text", "1 as score", "2 as h"), shard=shard, group=group).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    counts = Counter(x for d, t in texts if fold(d) != 1 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    pairs, contexts = Counter(), Counter()
    for d, t in texts:
        if fold(d) != 1:
            line = ["begin", *tokens(t)]
            ok = lambda x: x in ("begin", None) or counts[x] >= 3
            pairs.update((a, b) for a, b in zip(line, line[1:]) if ok(a) and ok(b))  # noqa: B905
            contexts.update(line[:-1])
    ones, twos = sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values())
    discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
    share = {k: eftrie.SHARES[int(eftrie.share_codes(np.array([(c - discount) / contexts[k[0]]]))[0])] for k, c in pairs.items() if c > 1}
    used = Counter()
    for (a, _), s in share.items():
        used[a] += s
    p1 = lambda x: (counts[x] + 0.5) / (n + 0.5 * (v + 1))
    rest = lambda a: math.floor((1 - used[a]) * 65535) / 65535 if a in used else 1.0
    want = []
    for d, t in texts:
        line = ["begin", *tokens(t)]
        score = sum(math.log10(share.get((a, b), 0) + rest(a) * p1(b)) for a, b in zip(line, line[1:]))  # noqa: B905
        want.append((d, fold(d) == 1, len(line) - 1, sum(counts[x] > 0 for x in line[1:]), n, round(sum(math.log10(p1(x)) for x in line[1:]), 5), round(score, 2)))
    assert sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 2)) for r in got), key=str) == sorted(want, key=str)


def test_lm_without_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert eftrie.score(empty).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = eftrie.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (row["train_tokens"], row["n_known"], row["n_tokens"], row["score"]) == (0, 0, 3, 0.0)


def _prose(rng, n):
    vocab = ["the", "of", "and", "to", "in", *("".join(rng.choices("abcdeghilmnorst", k=rng.randint(3, 9))) for _ in range(300))]
    out = []
    while n > 0:
        size = min(n, rng.randint(5, 15))
        s = [rng.choice(vocab[:5]) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(size)]
        out.append(" ".join(s).capitalize() + ".")
        n -= size
    return " ".join(out)


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    symbols = knmodel.Symbols(["the", "of", "and"])
    counts: Counter = Counter()
    for _ in range(40):
        s = np.concatenate(([knmodel.BEGIN], symbols.encode(_prose(rng, 60))))
        counts.update(((s[:-2] * symbols.size + s[1:-1]) * symbols.size + s[2:]).tolist())
    shard = knmodel.kneser_ney(counts, symbols.size)
    for a, b in ((0, 0), (0, 11), (3, 8), (8, 4), (10, 10), (11, 3)):
        p = [10 ** shard.log10(np.array([a, b, c]))[-1] for c in range(symbols.size)]
        assert sum(p) == pytest.approx(1, abs=1e-6)


def test_symbols():
    s = knmodel.Symbols(["the"])
    k = knmodel
    first = k.FIRST_WORD
    assert s.encode("The the cat, CAT 12 a$b x! x...").tolist() == [k.BEGIN, first + 1, first, k.LOWER, k.COMMA, k.UPPER, k.DIGITS, k.ODD, k.LOWER, k.MARK, k.REPEAT, k.MARK, k.MARK, k.MARK, k.END]
    assert s.encode(None).size == s.encode(" \n").size == 0


def test_classifier_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        lang = ["en", "fr", None][i % 3]
        good = i % 10 > 1
        text = _prose(rng, rng.choice([40, 100, 300])) if good else rng.choice(["BUY NOW!! ", "a$$$ b%%% ", "word word word word "]) * 30
        rows.append((i, text, lang, "clash"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(600, None, "en", "c"), (601, "", "fr", "c"), (602, " \n", "xx", "c"), (603, _prose(rng, 20_000), "en", "c"), (604, _prose(rng, 100), "yy", "c"), (1, rows[1][1], "fr", "c"), (None, _prose(rng, 50), "en", "c")]
    labels += [(9999, 1, 0), (None, 1, 0), (1, 1, 0), (3, 0, 0), (5, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = knmodel.classify(docs, marks, least=20).collect()
    assert len(got) == len(rows)
    good = [r["keep"] for r in got if r["doc_id"] is not None and (r["doc_id"] < 500 and r["doc_id"] % 10 > 1 or r["doc_id"] in (603, 604))]
    junk = [r["keep"] for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and r["doc_id"] % 10 <= 1]
    assert sum(good) >= 0.95 * len(good) and sum(junk) <= 0.1 * len(junk)
    assert [r["keep"] for r in got if r["doc_id"] in (600, 601, 602)] == [False] * 3
    assert knmodel.classify(docs.limit(0), marks).count() == 0
    assert {r["keep"] for r in knmodel.classify(docs.where("doc_id >= 600"), marks.limit(0)).where("doc_id >= 603").collect()} == {True}
