from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, empty, null and long texts; repeated and null ids."""
    rng = random.Random(5)
    vocab = ["w" + "".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = prose(30)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng.choice([1, 2, 3, 8, 40, 120]))))
    base = prose(200)
    for i in range(60, 90):  # near copies: a few words changed
        words = base.split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(90 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(100 + i, f"{prose(20)}\n{shared}  {prose(5 * i)}") for i in range(12)]
    rows += [(120, None), (121, ""), (122, " \n\t "), (123, "one"), (124, "One"), (125, "é x Ünï 漢字 <|endoftext|> a  \n\n\n b\n"), (126, prose(6000))]
    rows += [(5, rows[5][1]), (None, prose(50)), (None, rows[70][1])]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
