"""Columns of the input that bear names which an operator uses inside or adds."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, decontaminate, htmltext, knmodel, surrogates, urlfilter

INSIDE = ["__key", "__swap", "__names", "__parts", "__spelt", "__html", "__url", "__lang", "__text", "__id", "found", "mention"]
HTML = "<html><body><article><h1>A title</h1><p>The first paragraph of a text that says something at length.</p></article></body></html>"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeghil", k=5)) for _ in range(60)]
    data = [(i, " ".join(rng.choices(words, k=60)), "en", f"https://a{i}.example.net/en/{i}", HTML) for i in range(40)]
    data += [(50, "write to joe.b@mail.example.com or Mr. John Smith, who is Smith", "en", None, None), (51, None, None, "x", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, url string, html string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, data[7][1]), (2, data[8][1])], "item_id long, text string")
    return docs, labels, bench


def _planted(docs, names):
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.array(F.lit(i), F.col("doc_id").cast("int")))
    return docs


OPERATORS = {
    "url": (lambda d, lab, ben: urlfilter.filter_urls(d, urlfilter.DEFAULT_TERMS), ["host", "path", "rule", "verdict", "matched", "N_TRIED"]),
    "pii": (lambda d, lab, ben: surrogates.replace(d, "key"), ["N_Entities"]),
    "quality": (lambda d, lab, ben: knmodel.classify(d, lab), ["n_symbols", "PERPLEXITY", "threshold", "keep"]),
    "html": (lambda d, lab, ben: htmltext.extract_text(d), ["n_chars", "N_KEPT", "n_blocks"]),
    "bench": (lambda d, lab, ben: decontaminate.decontaminate(d, ben), ["n_words", "N_HIT", "items", "spans", "contaminated"]),
    "bench in blocks": (lambda d, lab, ben: decontaminate.decontaminate(d, ben, block_words=20), ["n_words", "n_hit", "items", "SPANS", "contaminated"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(rows, name):
    docs, labels, bench = rows
    run, added = OPERATORS[name]
    plain = run(docs, labels, bench)
    got = run(_planted(docs, INSIDE + added), labels, bench)
    assert sorted(got.columns) == sorted([*plain.columns, *INSIDE])
    want = {r["doc_id"]: r for r in plain.collect()}
    for r in got.collect():
        assert all(r[c] == want[r["doc_id"]][c] for c in plain.columns)
        assert all(r[c] == [i, r["doc_id"]] for i, c in enumerate(INSIDE))


def test_pipeline_stages_keep_the_values(spark, rows, tmp_path):
    docs, labels, bench = rows
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = INSIDE + ["n_symbols", "Perplexity", "threshold", "keep", "keep_", "n_words", "N_HIT", "items", "spans", "contaminated", "n_entities", "gone", "id"]
    docs = _planted(docs, names)
    for _, stage in P.STAGES[:4]:
        kept = common.materialize(stage(spark, docs, str(tmp_path)), "clash")
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        found = kept.collect()
        assert found and all(r[c] == [i, r["doc_id"]] for r in found for i, c in enumerate(names))
        docs = kept
