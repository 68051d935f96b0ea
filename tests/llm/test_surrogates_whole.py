"""Personal data that bounds of the patterns used to leave in the text."""

from __future__ import annotations

import re

from ledgerline.llm import surrogates

JWT = "eyJhbGciOiJI.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"
ROWS = [
    (1, "token=" + "Ab3" * 100 + " end"),
    (2, f'token: "{JWT}" and token={JWT}, and token={JWT}### end'),
    (3, "password=p@Q#ss$wX!9zY~ then pwd: 'x\"y(z)w{v}u' end"),
    (4, "_ann.bee@x.org_ and ann.bee@x.org, -ann.bee@x.org- end"),
    (5, "andré.55@mail4.example.com and " + "q" * 90 + "@a.b.c.d.e.f.g.h.i.j.k.l.org end"),
    (6, "Mr. John Smith came. Smith said John's SMITH; a smith and Smithson. Smith-Jones end"),
    (7, "Smith was never titled here: 1."),
    (8, "MRS. ANNA BERGER left. Berger came, token=******** end"),
]


def test_nothing_is_left(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in surrogates.replace(df, "k").collect()}
    text = {k: r["text"] for k, r in got.items()}
    assert all(text[i].endswith(" end") for i in text if i != 7)
    assert "Ab3" not in text[1] and re.fullmatch(r"token=\w{300} end", text[1])
    one, two, three = re.fullmatch(r'token: "(\S+)" and token=(\S+), and token=(\S+)### end', text[2]).groups()
    assert one == two == three and not set(one.split(".")) & set(JWT.split(".")) and [len(x) for x in one.split(".")] == [len(x) for x in JWT.split(".")]
    value = re.fullmatch(r"password=(\S+) then pwd: '(\S+)' end", text[3]).groups()
    assert re.sub(r"\w", "", value[0]) == "@#$!~" and re.sub(r"\w", "", value[1]) == '"(){}'
    assert not re.search(r"p@Q|ss\$|wX!9|zY", value[0]) and value[1] != 'x"y(z)w{v}u'
    mails = re.fullmatch(r"_(\S+)_ and (\S+), -(\S+)- end", text[4]).groups()
    assert len(set(mails)) == 1 and "ann" not in mails[0] and mails[0].endswith(".example.org")
    assert not re.search("andr|é|55|qqq|a.b.c", text[5]) and text[5].count(".example.org") == 2
    given, family = re.match(r"Mr\. (\S+) (\S+) came", text[6]).groups()
    assert text[6] == f"Mr. {given} {family} came. {family} said {given}'s {family.upper()}; a smith and Smithson. Smith-Jones end"
    assert got[6]["n_entities"] == 4 and text[7] == dict(ROWS)[7]
    assert re.fullmatch(r"MRS\. \S+ (\S+) left\. (\S+) came, token=\*{8} end", text[8]) and "Berger" not in text[8]


def test_long_chains_of_name_parts_do_not_overflow(spark):
    chains = ["a-" * 300_000 + "b", "a'" * 5000 + "b", "é’" * 5000 + "e", "a.b" * 5000, "1-" * 5000, "a@" * 5000, "x@a." * 3000, "DE12 " * 5000, "1." * 5000, "token=" * 3000]
    docs = spark.createDataFrame([(i, f"Mr. Smith said {c} and Smith") for i, c in enumerate(chains)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, "k").collect()}
    assert len(out) == len(chains) and all("Smith" not in t for t in out.values())
    assert out[0].count("a-") == 300_000 and out[1].count("a'") == 5000
