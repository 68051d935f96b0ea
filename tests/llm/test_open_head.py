"""Pages whose head and body tags are left out."""

from __future__ import annotations

import random
import re

from ledgerline.llm import htmltext


def test_an_open_head_ends_where_html_ends_it():
    text = lambda h: [b.text for b in htmltext.leaf_blocks(h)]
    assert text("<head><title>T</title><p>Article<p>more") == ["Article", "more"]
    assert text("<html><head><meta charset=x><link href=y><style>p{}</style><script>s</script><noscript><p>no</p></noscript><template><p>t</p></template><base href=z>\n<a href=q>in</a>") == ["in"]
    assert text("<head><title>T</title>bare <b>text</b>") == ["bare text"]
    assert text("<head><title>T</title></head><body><p>x") == ["x"]


def test_text_without_head_and_body_tags():
    crf, rng = htmltext.trained(), random.Random(5)
    for _ in range(20):
        page = "<html><head><title>T</title></head><body>" + re.sub(r"</?(?:html|body)[^>]*>|<head>.*?</head>", "", htmltext.labelled_page(rng)[0], flags=re.S)
        want = htmltext.extract(page, crf)
        assert want[0] and htmltext.extract(page.replace("</head><body>", ""), crf) == want


def test_stray_quotes_end_no_tag_later():
    second = "<p>It's the second one.</p><p>Third \"one\" here.</p>"
    for tag in ("<p title=it's>", "<p it's>", "<p a='x'y'>", '<p a="x"">', "<p a=b'c=\"d>", "<p title='a > b' it's>", "<p a = 'it\"s' \">", "<p a=>", "<p href=x?q='1'>"):
        blocks = [b.text for b in htmltext.leaf_blocks(f"{tag}One paragraph.</p>{second}")]
        assert blocks == ["One paragraph.", "It's the second one.", 'Third "one" here.'], tag
    assert [b.text for b in htmltext.leaf_blocks("<p title='never closed>text</p><p>more</p>")][-1] == "more"
