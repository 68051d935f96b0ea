"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks (runs of text between block-level tags) in page order,
each with its ancestors and the share of its text inside links. Every block
gets binary features of its ancestors (tags, words of class, id and role) and of its text;
a two-label linear-chain CRF (content or not), trained by maximum likelihood on
labelled pages, is decoded by Viterbi. The content blocks, joined by a line break, are the text.

Null and empty pages, and pages without a content block, give an empty text. Repeated pages
are extracted once each; other columns pass through. No text is cut, whatever its length.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(
    # a quote opens a value only after "="; elsewhere it is an ordinary character of a name or an unquoted value
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of the HTML standard: elements by how they are parsed and laid out. INLINE ones end no block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
UNSEEN = frozenset("script style template head title noscript iframe object svg math canvas datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr script style template noscript object svg math canvas".split()
)
_P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"},
}
_SCOPES = frozenset("ul ol dl table select".split())
#: What may stand in a head: any other start tag, and text, ends it.
_IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order. ``path``: an entry for each ancestor, the tag
    with the words of its class, id and role."""
    if not page:
        return []
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    hidden = link = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = tuple(x[1] for x in stack if x[0] not in INLINE)
                blocks.append(Block(text, path, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden, link
        while len(stack) > to:
            tag = stack.pop()[0]
            hidden -= tag in UNSEEN
            link -= tag == "a"

    def leave_head() -> None:
        pop(len(stack) - 1)
        stack.append(("body", "body"))

    def add(raw: str) -> None:
        nonlocal linked
        if raw and stack and stack[-1][0] == "head" and not raw.isspace():
            leave_head()
        if raw and not hidden:
            if "&" in raw:
                raw = htmllib.unescape(raw)
            parts.append(raw)
            if link:
                linked += len(raw.strip())

    at, end = 0, len(page)
    find = _TOKEN.search
    while at < end:
        m = find(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if stack and stack[-1][0] == "head" and tag not in _IN_HEAD and tag not in ("body", "head"):
            leave_head()
        if tag not in INLINE:
            flush()
            if tag in _P_ENDERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag in _SIBLINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _SIBLINGS[tag]:
                        pop(i)
                        break
                    if stack[i][0] in _SCOPES:
                        break
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/") and tag not in RAW:
            continue
        words = ""
        if "=" in attrs:
            words = " ".join(
                w.lower() for x in _ATTR.findall(attrs) for w in _WORD.findall(x[0] or x[1] or x[2])
            )
        stack.append((tag, f"{tag} {words}" if words else tag))
        hidden += tag in UNSEEN
        link += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return blocks


# --- features ---------------------------------------------------------------------


@lru_cache(maxsize=20000)
def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    out = {"bias"}
    for i, x in enumerate(reversed(path)):
        tag, *words = x.split()
        out.add(f"in:{tag}")
        if i == 0:
            out.add(f"leaf:{tag}")
        out.update(f"word:{w}" for w in words)
    if len(path) >= 2:
        out.add(f"pair:{path[-2].split()[0]}>{path[-1].split()[0]}")
    return tuple(sorted(out))


def text_features(block: Block) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    out = [f"words:{min(6, n.bit_length())}", f"linked:{math.ceil(block.linked * 3)}"]
    if text[-1] in ".!?…":
        out.append("stop")
    if "©" in text or "all rights reserved" in text.lower():
        out.append("rights")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    return [[*path_features(b.path), *text_features(b)] for b in blocks]


# --- the model ----------------------------------------------------------------------


class Crf:
    """Two labels (0 other, 1 content). ``weights``: for each feature what it adds to
    content over other; ``edges``: by the previous and the present label."""

    def __init__(self, weights: dict[str, float] | None = None, edges: list[list[float]] | None = None):
        self.weights = weights or {}
        self.edges = edges or [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in rows]

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        e = self.edges
        s0, s1 = 0.0, scores[0]
        back: list[tuple[int, int]] = []
        for x in scores[1:]:
            a0, b0, a1, b1 = s0 + e[0][0], s1 + e[1][0], s0 + e[0][1], s1 + e[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = max(a0, b0), max(a1, b1) + x
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Each block's probability of content, and the expected count of each edge."""
        e, n = self.edges, len(scores)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        forward = [(0.0, scores[0])]
        for x in scores[1:]:
            a, b = forward[-1]
            forward.append((add(a + e[0][0], b + e[1][0]), add(a + e[0][1], b + e[1][1]) + x))
        backward = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            a, b = backward[i + 1]
            x = scores[i + 1]
            backward[i] = (add(e[0][0] + a, e[0][1] + x + b), add(e[1][0] + a, e[1][1] + x + b))
        z = add(*forward[-1])
        p = [math.exp(f[1] + b[1] - z) for f, b in zip(forward, backward, strict=True)]
        edge = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n - 1):
            for j in (0, 1):
                for k in (0, 1):
                    edge[j][k] += math.exp(forward[i][j] + e[j][k] + k * scores[i + 1] + backward[i + 1][k] - z)
        return p, edge


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by AdaGrad over (features, labels) of each page."""
    crf, squares, edge_squares = Crf(), {}, [[1e-6, 1e-6], [1e-6, 1e-6]]
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(pages)
        for rows, labels in pages:
            if not rows:
                continue
            p, expected = crf.marginals(crf.scores(rows))
            gradient: dict[str, float] = {}
            for row, label, q in zip(rows, labels, p, strict=True):
                for f in row:
                    gradient[f] = gradient.get(f, 0.0) + label - q
            for f, g in gradient.items():
                w = crf.weights.get(f, 0.0)
                g -= decay * w
                squares[f] = squares.get(f, 1e-6) + g * g
                crf.weights[f] = w + rate * g / math.sqrt(squares[f])
            for j in (0, 1):
                for k in (0, 1):
                    g = sum(a == j and b == k for a, b in zip(labels, labels[1:])) - expected[j][k]  # noqa: B905
                    edge_squares[j][k] += g * g
                    crf.edges[j][k] += rate * g / math.sqrt(edge_squares[j][k])
    return crf


# --- labelled pages --------------------------------------------------------------------

#: What labelled pages call their parts: (tags, class or id words) by what they hold.
_OTHER = {
    "menu": (["nav", "div", "ul", "div", "header"], "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs toc"),
    "head": (["header", "div", "header"], "header masthead banner topbar branding sitehead logo"),
    "foot": (["footer", "div", "footer"], "footer foot bottom copyright legal colophon"),
    "side": (["aside", "div", "aside"], "sidebar side aside widget related recommended trending popular rail more"),
    "note": (["div", "section", "div"], "notice cookie consent alert gdpr banner popup modal message warning disclaimer"),
    "advert": (["div", "aside", "ins", "section"], "ad ads advert advertisement sponsored promo sponsor adsbox"),
    "form": (["form", "form", "div"], "form newsletter subscribe search login signup contact"),
    "comment": (["section", "div", "ol", "ul"], "comment comments reply replies discussion respond disqus commentlist"),
    "share": (["div", "ul"], "share social sharing tags meta byline follow"),
}
_CONTENT = (["article", "main", "div", "section", "div", "td"], "article content post entry body story main text page maincontent articlebody")


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made-up page and the label of each of its leaf blocks, in order."""
    syllables = [a + b for a in "b d f g k l m n p r s t v z th".split() for b in "a e i o u an er".split()]
    labels: list[int] = []
    out: list[str] = []

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        s = words(rng.randint(lo, hi))
        return s.capitalize() + rng.choice([".", ".", ".", "!", "?", "", " &amp; " + words(2) + "."])

    def prose() -> str:
        s = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6])))
        if rng.random() < 0.2:
            s = f"<b>{s}" + rng.choice(["</b>", "", "<br>"])
        if rng.random() < 0.15:
            s += f' <a href="/{words(1)}">{words(rng.randint(1, 4))}</a> {sentence()}'
        return s

    def block(tag: str, text: str, label: int, close: bool = True) -> None:
        out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        labels.append(label)

    def links(n: int, label: int) -> None:
        out.append("<ul>")
        for _ in range(n):
            block("li", f'<a href="/{words(1)}">{words(rng.randint(1, 3))}</a>', label)
        out.append("</ul>")

    def named(kinds: tuple[list[str], str], bare: float) -> str:
        tag = rng.choice(kinds[0])
        if tag not in ("div", "section", "ul", "ol", "td", "ins") and rng.random() < bare:
            return tag
        name = rng.choice(kinds[1].split())
        name = rng.choice([name, name, f"{name}-{words(1)}", f"{words(1)}-{name}", f"{name} {words(1)}"])
        return f'{tag} {rng.choice(["class", "class", "id"])}="{name}"'

    def other(kind: str) -> None:
        tag = named(_OTHER[kind], 0.6)
        name = tag.split()[0]
        out.append(f"<{tag}>")
        if kind in ("menu", "share") or kind in ("side", "foot", "head") and rng.random() < 0.5:
            if name in ("ul", "ol"):
                for _ in range(rng.randint(2, 6)):
                    block("li", f'<a href="#">{words(rng.randint(1, 3))}</a>', 0)
            else:
                links(rng.randint(2, 6), 0)
        elif kind == "form":
            for _ in range(rng.randint(1, 2)):
                block("label", words(rng.randint(1, 4)), 0)
            out.append('<input type="text">')
            block("button", words(rng.randint(1, 2)), 0)
        elif name in ("ul", "ol"):
            for _ in range(rng.randint(1, 5)):
                block("li", prose(), 0)
        elif kind in ("comment", "side"):
            block("h3", words(rng.randint(1, 3)), 0)
            for _ in range(rng.randint(1, 5)):
                block(rng.choice(["p", "div", "p"]), prose(), 0, close=True)
        elif rng.random() < 0.5:  # text straight in the part
            out.append(rng.choice(["&copy; ", ""]) + prose() if kind == "foot" else prose())
            labels.append(0)
        else:
            for _ in range(rng.randint(1, 3)):
                block("p", prose(), 0)
        out.append(f"</{name}>")

    def article() -> None:
        tag = named(_CONTENT, 0.8)
        name = tag.split()[0]
        if name == "td":
            out.append("<table><tr>")
        out.append(f"<{tag}>")
        inner = rng.random() < 0.25
        if inner:
            out.append(f'<div class="{rng.choice(_CONTENT[1].split())}">')
        if rng.random() < 0.85:
            block("h1", sentence(), 1)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            if kind < 0.7:
                block("p", prose(), 1, close=rng.random() < 0.85)
            elif kind < 0.76:
                block(rng.choice(["h2", "h3"]), words(rng.randint(1, 6)), 1)
            elif kind < 0.81:
                out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    block("li", sentence(), 1)
                out.append("</ul>")
            elif kind < 0.84:
                block("blockquote", sentence(), 1)
            elif kind < 0.86:
                block("pre", sentence(), 1)
            elif kind < 0.89:
                out.append("<figure><img src='x'>")
                block("figcaption", sentence(), 1)
                out.append("</figure>")
            elif kind < 0.91:
                out.append("<table>")
                for _ in range(2):
                    out.append("<tr>")
                    block("td", words(2), 1)
                    block("td", words(2), 1)
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.95:
                block("div", prose(), 1)
            else:
                other(rng.choice(["advert", "share", "side", "form", "note"]))
        if inner:
            out.append("</div>")
        if rng.random() < 0.1:
            other("comment")
        out.append(f"</{name}>" + ("</tr></table>" if name == "td" else ""))

    before = [k for k in ("note", "head", "menu", "advert", "form") if rng.random() < 0.6]
    after = [k for k in ("comment", "side", "advert", "form", "share", "menu", "foot") if rng.random() < 0.5]
    out.append(f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style></head><body>")
    wrap = rng.random() < 0.3
    out.append(f'<div class="{rng.choice(["wrapper", "container", "page", "site", "row"])}">' if wrap else "")
    for kind in before:
        other(kind)
    if rng.random() < 0.25:
        other("side")
    article()
    for kind in after:
        other(kind)
    out.append(("</div>" if wrap else "") + "</body></html>")
    return "".join(out), labels


@lru_cache(maxsize=4)
def trained(n_pages: int = 500, seed: int = 20) -> Crf:
    rng = random.Random(seed)
    rows = []
    for _ in range(n_pages):
        page, labels = labelled_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            rows.append((features(blocks), labels))
    return train(rows)


def extract(page: str | None, crf: Crf, cache: dict | None = None) -> tuple[str, int, int]:
    """The main text, and how many of how many blocks it holds."""
    blocks = leaf_blocks(page)
    cache = {} if cache is None else cache
    scores = []
    for b in blocks:
        s = cache.get(b.path)
        if s is None:
            if len(cache) > 50_000:
                cache.clear()
            s = cache[b.path] = sum(crf.weights.get(f, 0.0) for f in path_features(b.path))
        scores.append(s + sum(crf.weights.get(f, 0.0) for f in text_features(b)))
    kept = [b.text for b, label in zip(blocks, crf.viterbi(scores), strict=True) if label]
    return "\n".join(kept), len(kept), len(blocks)


def extract_text(pages: DataFrame, html_col: str = "html", crf: Crf | None = None) -> DataFrame:
    """The columns of ``pages`` without the HTML, and ``text, n_chars`` (code points),
    ``n_kept`` and ``n_blocks``; columns of ``pages`` with these names (case ignored) are
    replaced."""
    common.prepare(pages.sparkSession)
    model = crf or trained()
    added = ["text", "n_chars", "n_kept", "n_blocks"]
    kept = common.others(pages.columns, [*added, html_col])
    own = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            rows = [extract(x, model, cache) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *added])

    read = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").alias(common.spare(kept, "__html")))
    return read.mapInArrow(run, f"{own}text string, n_chars bigint, n_kept bigint, n_blocks bigint")
