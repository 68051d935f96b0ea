"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it fits must
hold. The operator counts in how many URLs each of the rules' tokens occurs, files
every rule under its rarest one, and then looks up each URL's tokens in that index.
Only the rules so fetched run their regular expression.

Site rules (a host with a path prefix) are compiled to such patterns as well. A site
rule that fits decides, the longest first; otherwise a page is blocked if a pattern
rule fits, and else allowed.

The rule list is an argument, at most ``MAX_RULES`` rules; it and the counts of its
tokens are all that is sent to the tasks. Null URLs and URLs without ``://`` have an empty
host and path, fit no rule and are allowed. Rows are judged one by one, so repeated
rows and empty tables need no care; a column that bears an added one's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_RULES = 100_000
_TOKENS = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``tokens``: lower-case runs of ``[a-z0-9]``, delimited as such in every URL that the
    pattern fits. Patterns see the URL as ``host/path?query#fragment``, host and rest
    in lower case, or for site rules the host and the path as it is."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False
    length: int = 0


def site_rule(action: str, where: str) -> Rule:
    """``where``: host and path prefix, such as ``example.net/en/``. Fits the host and its
    subdomains where the path starts with the prefix."""
    host, slash, rest = where.partition("/")
    path = slash + rest
    pattern = rf"(?:[^\x00]*\.)?{re.escape(host.translate(_LOWER))}\x00{re.escape(path)}"
    # the host's labels are whole tokens; of the path only what a delimiter follows
    tokens = _TOKENS.findall(host.translate(_LOWER)) + [m for m in _TOKENS.findall(path.rpartition("/")[0].translate(_LOWER))]
    return Rule(where, action, pattern, tuple(dict.fromkeys(tokens)), True, len(where))


def term_rule(*words: str, action: str = "block") -> Rule:
    """Fits URLs that hold the words one after the other, as whole tokens with one
    delimiter between two."""
    inner = r"[^a-z0-9]".join(map(re.escape, words))
    return Rule("-".join(words), action, rf"(?<![a-z0-9]){inner}(?![a-z0-9])", words)


#: Pattern rules of the method: what unwanted sites are called.
DEFAULT_TERMS = tuple(
    term_rule(*x.split("-"))
    for x in (
        "adult", "ads-track", "casino", "casino-win", "cheap-pills", "free-bets", "spam-farm", "porn", "xxx", "viagra", "escort",
        "betting", "payday-loans", "doubleclick", "adserver", "phishing", "malware", "warez",
    )
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_LOWER), m[2]


def _url_tokens(url: str) -> set[str]:
    return set(_TOKENS.findall(url.partition("://")[2].translate(_LOWER)))


class RuleIndex:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules:
            token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            self.by_token.setdefault(token, []).append((rule, re.compile(rule.pattern)))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, list[str], int]:
        """Host, path, deciding site rule, verdict, fitting pattern rules, and how many
        regular expressions ran."""
        host, path = split_url(url)
        site, terms, ran = None, [], 0
        if url and "://" in url:
            rest = url.partition("://")[2].translate(_LOWER)
            site_text = f"{host}\x00{path}"
            for token in _url_tokens(url):
                for rule, pattern in self.by_token.get(token, ()):
                    ran += 1
                    if rule.site:
                        if pattern.match(site_text) and (site is None or (rule.length, rule.name) > (site.length, site.name)):
                            site = rule
                    elif pattern.search(rest):
                        terms.append(rule)
        verdict = site.action if site else "block" if any(r.action == "block" for r in terms) else "allow"
        return host, path, site.name if site else None, verdict, sorted(r.name for r in terms), ran


def token_counts(urls: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs (over all URLs)."""
    wanted = sorted({t for r in rules for t in r.tokens})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = set(wanted), {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in _url_tokens(url or "") & known:
                    n[t] = n.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    counted = urls.select(F.col(f"`{url_col}`").alias("url")).mapInArrow(count, "token string, n bigint")
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> DataFrame:
    """Adds ``host, path, rule, verdict, matched`` (names of the pattern rules that fit)
    and ``n_tried`` (regular expressions that ran) to the columns of ``pages``, whose own of these
    names (case ignored) are replaced."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token")
    common.prepare(pages.sparkSession)
    counts = token_counts(pages, url_col, rules)

    added = "host string, path string, rule string, verdict string, matched array<string>, n_tried int"
    names = [x.split()[0] for x in added.split(", ")]
    kept = common.others(pages.columns, names)
    own = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            rows = [index.judge(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    read = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url_col}`").alias(common.spare(kept, "__url")))
    return read.mapInArrow(run, f"{own}{added}")
