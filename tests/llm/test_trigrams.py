"""The registered language-model query against a brute-force trigram model without pruning."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import eftrie, queries


def _want(texts):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    counts, contexts, pairs, triples = Counter(), Counter(), Counter(), Counter()
    for d, t in texts:
        if fold(d) != 1:
            line = ["begin", *tokens(t)]
            counts.update(line[1:])
            contexts.update(line[:-1])
            pairs.update(zip(line, line[1:]))  # noqa: B905
            triples.update(zip(line, line[1:], line[2:]))  # noqa: B905
    kinds = lambda c, n: sum(x == n for x in c.values())
    discount = lambda c: min(0.95, max(0.1, kinds(c, 1) / max(1, kinds(c, 1) + 2 * kinds(c, 2))))
    d2, d3 = discount(pairs), discount(triples)
    share = {k: eftrie.SHARES[int(eftrie.share_codes(np.array([(c - d2) / contexts[k[0]]]))[0])] for k, c in pairs.items()}
    used, follow, total = Counter(), Counter(), Counter()
    for (a, _), s in share.items():
        used[a] += s
    for (a, b, _), c in triples.items():
        follow[a, b] += 1
        total[a, b] += c
    n, v = sum(counts.values()), len(counts)

    def p(line, i):
        out = (counts[line[i]] + 0.5) / (n + 0.5 * (v + 1))
        a, w = line[i - 1], line[i]
        out = share.get((a, w), 0) + (math.floor((1 - used[a]) * 65535) / 65535 if a in used else 1.0) * out
        if i > 1 and total[line[i - 2], a]:
            pair = line[i - 2], a
            out = (max(triples[(*pair, w)] - d3, 0) + d3 * follow[pair] * out) / total[pair]
        return out

    for d, t in texts:
        line = ["begin", *tokens(t)]
        yield d, len(line) - 1, n, round(sum(math.log10(p(line, i)) for i in range(1, len(line))), 3)


def test_registered_scores_drop_nothing(spark, documents, texts, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["train_tokens"], round(r["score"], 3)) for r in got), key=str) == sorted(_want(texts), key=str)


def test_small_shards_split_hot_pairs(spark, documents, texts):
    # one pair in every text, so that its successors are dealt to several shards
    hot = [(d, None if t is None else " ".join(f"of the {w}" for w in t.split())) for d, t in texts]
    df = spark.createDataFrame(hot, "doc_id long, text string").repartition(5)
    got = eftrie.score(df, shard=64, group=500, min_count=1, least=1, order=3).collect()
    want = sorted(_want(hot), key=str)
    assert [x[:3] for x in sorted(((r["id"], r["n_tokens"], r["train_tokens"], r["score"]) for r in got), key=str)] == [x[:3] for x in want]
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(x[3] for x in want), abs=1e-3)


def test_values_at_places():
    rng = np.random.default_rng(4)
    for n, top in ((1, 5), (1000, 1 << 62), (5000, 600), (2, 1 << 62)):
        values = np.sort(rng.integers(0, top, n))
        assert eftrie.EliasFano.encode(values).at(np.arange(n)).tolist() == values.tolist()
