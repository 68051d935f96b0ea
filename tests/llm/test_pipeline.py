"""The pipeline's stages take effect, on a small folder of tables with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest

from ledgerline.llm import common, decontaminate, packing, queries


def _prose(rng, n):
    vocab = ["the", "of", "and", "to", *("".join(rng.choices("abcdeghilmnorst", k=rng.randint(3, 8))) for _ in range(200))]
    return " ".join(" ".join(rng.choices(vocab, k=rng.randint(6, 12))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, _prose(rng, rng.choice([4, 10, 30]))) for i in range(200)]
    items = [(i, _prose(rng, 5)) for i in range(5)]
    rows += [(200 + i, "WIN BIG!! " * 60) for i in range(10)]  # junk
    rows += [(300 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(320 + i, rows[30 + i][1] + " Zq.") for i in range(10)]  # near copies
    rows += [(400 + i, f"{_prose(rng, 3)} {items[i][1]} {_prose(rng, 3)}") for i in range(5)]  # contaminated
    rows += [(500, _prose(rng, 20) + " mail joe.x12@mail3.example.com now. " + _prose(rng, 5))]
    rows += [(600, None), (601, ""), (None, _prose(rng, 20))]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "s", len(t) if t is not None else None, "more") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, keep string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(200, 205)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, folder):
    path, rows, _ = folder
    docs = common.read_table(spark, path, "documents")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:4]:
        docs = common.materialize(stage(spark, docs, path), "stage")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    text = dict(rows)
    quality, near, clean, private = kept.values()
    assert not {600, 601} & set(quality) and not [i for i in quality if i is not None and 200 <= i < 210]
    # 100 documents set the thresholds: too few to tell a 0.995 quantile well
    assert sum(i in quality for i in range(200)) >= 180 and None in quality
    for i in range(10):
        assert not {i, 300 + i} <= set(near) and (i in near) == (i in quality)
        assert not {30 + i, 320 + i} <= set(near) and (30 + i in near) == (30 + i in quality)
    assert set(near) - set(clean) == {i for i in near if i is not None and 400 <= i < 405}
    assert set(private) == set(clean)
    changed = {i for i, r in private.items() if r["text"] != text[i]}
    assert changed == {500} and "joe" not in private[500]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in private.values())
    pieces = P.STAGES[4][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in pieces} == set(private)
    encoder = packing.Encoder(**queries.vocabulary())
    assert sum(r["length"] for r in pieces) == sum(len(encoder.encode(r["text"])) // 4 + 1 for r in private.values())


def test_stage_three_is_the_contract(spark, folder):
    path, rows, items = folder
    docs = common.read_table(spark, path, "documents")
    left = {r["doc_id"] for r in P.benchmark(spark, docs, path).collect()}
    index = decontaminate.Index([(i, decontaminate.words_of(t)) for i, t in items])
    for i, t in rows:
        words = decontaminate.words_of(t)
        hit = int(index.hits(words)[0].sum())
        assert (i in left) == (not (hit and 20 * hit >= len(words)))


def test_empty_documents(spark, folder):
    path, _, _ = folder
    docs = common.read_table(spark, path, "documents").limit(0)
    for _, stage in P.STAGES:
        out = common.materialize(stage(spark, docs, path), "stage")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_without_ids(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(1000)] + [(None, "y")], "doc_id long, __gone string")
    gone = spark.range(0, 1000, 3).withColumnRenamed("id", "g")
    left = {r["doc_id"] for r in common.without_ids(rows, "doc_id", gone).collect()}
    assert left == {i for i in range(1000) if i % 3} | {None}
