"""WARC bundles, URL rules and main text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, htmltext, urlfilter, warc
from ledgerline.llm.queries import SITE_RULES


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 3000
    rows = [(i, f"http://a/{i}", f"<p>é{i}" + "y" * (i * 40)) for i in range(60)]
    rows += [(100, "http://b\n", big), (101, None, big), (99, "u", big), (77, "again", big), (200, "s", "small"), (201, "s", "small"), (300, "n", None), (None, "z", "WARC/1.1\r\n\r\n" + "q" * 2000), (301, "x", "h" * 400_000)]
    rows += [(400, "r", "t" * 1500), (400, "r", "t" * 1500)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = common.shared_folder(common.prepare(spark), "warc-test")
    index = warc.write(pages, folder, frame_bytes=5000, bundle_bytes=20_000)
    assert index.select("bundle").distinct().count() > 3
    got = Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(index, folder).collect())
    best = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 1000 and (page or -1) > best.get(html, -2):
            best[html] = page
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        keeper = best.get(html, page) if len(data) >= 1000 else page
        own = keeper == page
        want[str(page) if page is not None else None, len(data), hashlib.sha1(data).hexdigest(), "response" if own else "revisit", None if own else str(keeper)] += 1
    assert got == want
    found = {r["page"]: r for r in warc.fetch(index, folder, spark.createDataFrame([(301,), (100,), (77,)], "page_id long")).collect()}
    assert found["301"]["payload"] == b"h" * 400_000 and found["77"]["payload"] is None and found["77"]["refers_to"] == "101"


def test_warc_empty_table(spark):
    folder = common.shared_folder(common.prepare(spark), "warc-test")
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert index.count() == 0 and warc.read(index, folder).count() == 0


URLS = {
    "http://EXAMPLE.net/en/x": ("example.net", "/en/x", "example.net/en/", "allow"),
    "https://a.example.net/fr/": ("a.example.net", "/fr/", "net/", "block"),
    "https://a.example.net": ("a.example.net", "", None, "allow"),
    "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
    "https://x.example.com/de/1?q": ("x.example.com", "/de/1", "example.com/de/", "block"),
    "https://x.example.com/DE/1": ("x.example.com", "/DE/1", None, "allow"),
    "ftp://y.org/fr/a#b": ("y.org", "/fr/a", "org/fr/", "allow"),
    "https://cheap-pills.org/fr/a": ("cheap-pills.org", "/fr/a", "org/fr/", "allow"),
    "https://cheap-pills.org/en/a": ("cheap-pills.org", "/en/a", None, "block"),
    "https://acheap-pills.org/en/a": ("acheap-pills.org", "/en/a", None, "allow"),
    "https://example.net:80/en/": ("example.net:80", "/en/", None, "allow"),
    "no scheme/casino": ("", "", None, "allow"),
    "a?://b/c": ("b", "/c", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "http://?casino=1": ("", "", None, "block"),
}


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, verdict string").repartition(3)
    got = urlfilter.filter_urls(pages, SITE_RULES + urlfilter.DEFAULT_TERMS).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["url"]], r["url"]
    assert urlfilter.filter_urls(pages.limit(0), SITE_RULES).count() == 0


def test_url_index_finds_what_all_rules_find():
    rng = random.Random(2)
    rules = SITE_RULES + urlfilter.DEFAULT_TERMS
    index = urlfilter.RuleIndex(rules, {t: rng.randrange(9) for r in rules for t in r.tokens})
    every = urlfilter.RuleIndex(rules, {})
    parts = ["example", "net", "org", "com", "cheap", "pills", "casino", "win", "fr", "de", "en", "ads", "track"]
    for _ in range(2000):
        url = "https://" + "".join(rng.choice(parts) + rng.choice([".", "-", "/", "/", "?", "_"]) for _ in range(rng.randint(1, 7)))
        assert index.judge(url)[:5] == every.judge(url)[:5]
        host, path = urlfilter.split_url(url)
        fits = [r for r in SITE_RULES for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert index.judge(url)[2] == (max(fits, key=lambda r: r.length).name if fits else None), url


def test_main_text_held_out():
    crf, rng, wrong, blocks = htmltext.trained(), random.Random(77), 0, 0
    for _ in range(150):
        page, labels = htmltext.labelled_page(rng)
        got = crf.viterbi(crf.scores(htmltext.features(htmltext.leaf_blocks(page))))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        blocks += len(labels)
    assert wrong / blocks < 0.02


def test_viterbi_and_marginals_agree_with_enumeration():
    from itertools import product
    from math import exp, log

    crf = htmltext.Crf({}, [[0.3, -0.7], [-1.1, 0.9]])
    scores = [0.5, -1.2, 0.1, 2.0, -0.4]
    total = lambda y: sum(s for s, a in zip(scores, y, strict=True) if a) + sum(crf.edges[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B905
    every = list(product((0, 1), repeat=5))
    assert tuple(crf.viterbi(scores)) == max(every, key=total)
    z = log(sum(exp(total(y)) for y in every))
    p, _ = crf.marginals(scores)
    for i in range(5):
        assert p[i] == pytest.approx(sum(exp(total(y) - z) for y in every if y[i]))


def test_leaf_blocks():
    text = lambda h: [b.text for b in htmltext.leaf_blocks(h)]
    assert text("<p>a<b>b</b> c<br>d<p>e &amp; f&nbsp;g") == ["ab c d", "e & f g"]
    assert text('<div>x<script>var t="</p>";</script>y<style>p{}</style><!-- <p>no --> z</div>') == ["xy z"]
    assert text("<ul><li>1<li>2</ul>3 < 4 <p") == ["1", "2", "3 < 4"]
    assert text(None) == text("") == text("<html><head><title>t</title></head></html>") == []
    assert text('<a title="x>y">k</a><article><p>in</article>out') == ["k", "in", "out"]
    assert text("<p>" + "long " * 50_000) == [("long " * 50_000).strip()]


def test_extract_text_frame(spark):
    page = "<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T.</h1><p>One  two.</p><div class=comments><p>Nice!</p></div></article><footer>(c)</footer>"
    rows = [(1, "u", page, "clash"), (2, None, None, None), (3, "v", "", "c"), (1, "u", page, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_text(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, "T.\nOne two.", 11), (1, "T.\nOne two.", 11), (2, "", 0), (3, "", 0)]
    assert htmltext.extract_text(pages.where(F.lit(False))).count() == 0
