"""op4, pipeline: the signatures are counted as packed arrays, not as rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import common, jaccard


@pytest.mark.parametrize("packed", [1, 7, 1 << 20])
def test_repeated_signatures_against_a_counter(spark, packed):
    common.prepare(spark)
    rng = random.Random(3)
    pool = [rng.randrange(1 << 62) for _ in range(60)] + [0, (1 << 62) - 1]
    lists = [[rng.choice(pool) if rng.random() < 0.3 else rng.randrange(1 << 62) for _ in range(rng.randint(0, 9))] for _ in range(80)]
    lists += [[5, 5], [0], [(1 << 62) - 1] * 2]
    rows = [(i, np.array(x, dtype=np.int64).tobytes()) for i, x in enumerate(lists)]
    signed = spark.createDataFrame(rows, "class long, signatures binary").repartition(4)
    often = jaccard._often(signed, packed)
    counts = Counter(t for x in lists for t in x)
    assert sorted(r["token"] for r in often.collect()) == sorted(t for t, c in counts.items() if c > 1)
    assert "HashAggregate" not in often._jdf.queryExecution().executedPlan().toString()
    assert jaccard._often(signed.limit(0)).count() == 0
