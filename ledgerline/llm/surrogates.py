"""Personal data replaced by surrogates, in DataFrame expressions only.

1. One pattern finds the mentions: e-mail and IP addresses, phone, card, bank and social security
   numbers, passwords, tokens and access keys (to the next quote or white space, however long), and
   names after a title. The parts of such a name are mentions wherever else they stand in the same text.
2. Each distinct mention becomes atoms (kind and canonical form): a phone's national digits,
   an address in lower case, a name's given and family parts. Forms of one entity share atoms,
   so every mention of it, in any document and format, gets one surrogate (coreference).
3. An atom's surrogate follows from a keyed hash and keeps its type and format: digits stay digits
   and letters letters of their case, cards keep their first digit and a valid check digit,
   names their gender and script.
4. Collisions are checked over the whole corpus: two atoms of a kind with one surrogate, or a
   surrogate that is some real atom, are drawn again (the atom of the lowest hash keeps it), with
   longer forms after a few draws, until all are distinct.
5. The mentions' replacements are joined to the distinct texts that hold them, and the
   text is put together from the pieces around them. Only texts with mentions are shuffled.

A null text stays null. Texts without mentions are untouched. Repeated rows and texts get equal
results. Empty tables give no rows. Other columns pass through; ``n_entities`` is added (and
replaces a column of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Titles by gender; they may be in capitals.
_TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Madame", "г-жа", "госпожа"),
    "n": ("Dr", "Prof"),
}
_ALL_TITLES = "|".join(sorted({x for v in _TITLES.values() for t in v for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
_LOCAL = r"[\p{L}\p{M}\p{N}._%+-]"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}"
#: What a secret does not end with: these stay where they are, and forms with and without them are one entity.
_SECRET_END = r"[^\p{L}\p{N}+/_-]*$"
#: Words of a text that may repeat a name's part, and what lies between them.
_WORDS = r"[\p{L}\p{M}]++(?:['’-][\p{L}\p{M}]++)*+|[^\p{L}\p{M}]++"
#: Kinds in the order in which they are tried at a place: the mention, then what must not stand before and after.
PATTERNS = {
    # a domain has at most 127 labels of 63 characters (DNS); the local part and a secret have no bound
    "email": (rf"[._%+-]*+[\p{{L}}\p{{N}}]{_LOCAL}*+@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,125}}\.[A-Za-z]{{2,63}}", _LOCAL, r"[A-Za-z0-9]"),
    "secret": (rf"{_SECRET}(?:\"(?=[^\"\s]*[\p{{L}}\p{{N}}])[^\"\s]{{8,}}+|'(?=[^'\s]*[\p{{L}}\p{{N}}])[^'\s]{{8,}}+|(?=[^\"'\s]*[\p{{L}}\p{{N}}])[^\"'\s]{{8,}}+)", r"[A-Za-z]", r"(?!)"),
    "access": (r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"[A-Za-z0-9]", r"[A-Za-z0-9]"),
    "iban": (r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Za-z0-9]", r"[A-Za-z0-9]"),
    "ip": (r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)", r"[\dA-Za-z.]", r"[\dA-Za-z]|\.\d"),
    "ssn": (r"\d{3}-\d{2}-\d{4}", r"[\dA-Za-z-]", r"[\dA-Za-z]|-\d"),
    "card": (r"\d{4}([ -]?)\d{4}\GROUP\d{4}\GROUP\d{1,7}", r"[\dA-Za-z.]", r"[\dA-Za-z]|\.\d"),
    "phone": (r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}", r"[\dA-Za-z+]", r"[\dA-Za-z]"),
    "name": (rf"(?:{_ALL_TITLES})\.?\s\p{{Lu}}[\p{{L}}'’-]{{1,40}}(?:\s\p{{Lu}}[\p{{L}}'’-]{{1,40}})?", r"[\p{L}\p{N}]", r"[\p{L}]"),
}
# one pattern for all: the card's separator is written out, since groups would be numbered anew
_CARD = r"(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7})"
PATTERNS["card"] = (_CARD, *PATTERNS["card"][1:])
MENTION = "|".join(f"(?<!{before})(?:{own})(?!{after})" for own, before, after in PATTERNS.values())

_NAMED = rf"(?=[{''.join(sorted({t[0] for t in _ALL_TITLES.split('|')}))}])(?<![\p{{L}}\p{{N}}])(?:{_ALL_TITLES})\.?\s\p{{Lu}}"


def may_hold(text: Column) -> Column:
    """What every text with a mention shows; cheaper to test than the mentions."""
    return text.rlike("[0-9@=:]") | text.contains("AKIA") | text.contains("ASIA") | text.rlike(_NAMED)


# Made-up names: given names by gender and family name parts, by script.
_GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Martin Oscar Paul Robin Simon Victor",
    ("latin", "f"): "Alba Berta Clara Diana Elena Flora Greta Helena Irene Julia Laura Maria Nora Olivia Rosa Sofia",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Олег Павел Роман Семён Тимур",
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Зоя Инна Кира Лидия Марина Нина Ольга Полина Раиса Софья",
}
_STEMS = {
    "latin": "al bar cor dan el fal gar hal jor kel lan mar nor ol par ros sal tor ver wal".split(),
    "cyrillic": "ал бар вол гор дан жел зор кал лан мар нор ол пав рос сав тор ул фед хол шар".split(),
}
_ENDINGS = {("latin", "m"): "son man ler ton field berg mann wood", ("cyrillic", "m"): "ов ев ин", ("cyrillic", "f"): "ова ева ина"}


def _list(words: str | list[str]) -> Column:
    return F.array(*[F.lit(w) for w in (words.split() if isinstance(words, str) else words)])


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th of the 64 bytes of a hex digest."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: Column, digest: Column, i: int) -> Column:
    return F.get(words, (_byte(digest, i) * 256 + _byte(digest, i + 1)) % F.size(words))


def _like(text: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case; all else stays."""
    a, big_a = ord("a"), ord("A")

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (
            F.when(c.rlike(r"\p{N}"), (b % 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.char(b % 26 + big_a))
            .when(c.rlike(r"[\p{L}\p{M}]"), F.char(b % 26 + a))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(body: Column) -> Column:
    """The check digit of a number without it."""
    def term(acc: Column, x: Column) -> Column:
        return acc + x

    doubled = F.transform(
        F.split(F.reverse(body), ""),
        lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")),
    )
    total = F.aggregate(F.transform(doubled, lambda x: F.coalesce(x, F.lit(0))), F.lit(0), term)
    return ((10 - total % 10) % 10).cast("string")


def kind_of(mention: Column) -> Column:
    out = None
    for kind, (own, _, _) in PATTERNS.items():
        test = mention.rlike(rf"^(?:{own})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _secret_value(mention: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(mention, rf"^{_SECRET}[\"']?", ""), _SECRET_END, "")


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^({_ALL_TITLES})\.?\s", 1)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def atoms(kind: Column, mention: Column) -> Column:
    """``array<struct<kind, canon>>`` of a mention: of a name its given (if any) and family part."""
    title = F.lower(_title(mention))
    gender = F.when(title.isin(*map(str.lower, _TITLES["m"])), "m").when(title.isin(*map(str.lower, _TITLES["f"])), "f").otherwise("n")
    words = F.split(F.regexp_replace(mention, rf"^({_ALL_TITLES})\.?\s", ""), r"\s")
    family, given = F.element_at(words, -1), F.get(words, F.lit(0))
    # a family name has a gendered form in Cyrillic only
    family_kind = F.concat(F.lit("family:"), _script(family), F.lit(":"), F.when(_script(family) == "cyrillic", gender).otherwise("n"))
    given_kind = F.concat(F.lit("given:"), _script(given), F.lit(":"), gender)
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    of_family = one(family_kind, F.lower(family))
    digits = _digits(mention)
    canon = (
        F.when(kind == "phone", F.when(F.length(digits) > 10, F.substr(digits, F.length(digits) - 9, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "email", F.lower(F.regexp_replace(mention, r"^[._%+-]+", "")))
        .when(kind == "secret", _secret_value(mention))
        .otherwise(mention)
    )
    named = F.when(F.size(words) > 1, F.array(one(given_kind, F.lower(given)), of_family)).otherwise(F.array(of_family))
    return F.when(kind == "name", named).otherwise(F.array(one(kind, canon)))


def _drawn(kind: Column, canon: Column, digest: Column, draw: Column) -> Column:
    """The surrogate of an atom. After three draws the open-ended kinds grow longer."""
    extra = F.substr(F.regexp_replace(F.translate(digest, "0123456789", "ghijklmnop"), "[^a-z]", ""), F.lit(1), F.greatest(draw - 2, F.lit(0)))
    local = F.substring_index(canon, "@", 1)
    email = F.concat(_like(local, digest), extra, F.lit("@mail"), (_byte(digest, 60) % 90 + 10).cast("string"), F.lit(".example.org"))
    octet = lambda i: _byte(digest, i).cast("string")
    ip = F.concat_ws(".", F.when(draw < 2, F.lit("10")).otherwise((_byte(digest, 8) % 223 + 1).cast("string")), octet(9), octet(10), octet(11))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(_like(canon, digest), F.lit(2), F.length(canon) - 2))
    card = F.concat(body, _luhn(body))
    phone = F.concat((_byte(digest, 20) % 8 + 2).cast("string"), F.substr(_like(canon, digest), F.lit(2), F.length(canon) - 1))
    ssn = F.concat(F.lit("9"), F.substr(_like(canon, digest), F.lit(2), F.lit(8)))
    keep = lambda n: F.concat(F.substr(canon, F.lit(1), F.lit(n)), F.substr(_like(canon, digest), F.lit(n + 1), F.length(canon) - n))
    out = (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "ssn", ssn).when(kind == "iban", keep(2)).when(kind == "access", keep(4)).when(kind == "secret", F.concat(_like(canon, digest), extra))
    )
    for script in ("latin", "cyrillic"):
        for gender in "mfn":
            names = _GIVEN[script, gender] if gender != "n" else f"{_GIVEN[script, 'm']} {_GIVEN[script, 'f']}"
            stems, joined = _list(_STEMS[script]), lambda n: F.concat(*[_pick(stems, digest, 30 + 2 * i) for i in range(n)])  # noqa: E731, B023
            given = F.concat(_pick(_list(names), digest, 40), F.when(draw > 0, F.concat(F.lit("-"), F.initcap(joined(2)))).otherwise(""))
            given = F.when(draw > 3, F.concat(given, joined(4))).otherwise(given)
            ends = _ENDINGS.get((script, gender), _ENDINGS[script, "m"])
            longer = F.when(draw > 0, joined(3)).otherwise(joined(2))
            longer = F.when(draw > 3, F.concat(joined(4), _pick(stems, digest, 50))).otherwise(longer)
            family = F.concat(F.initcap(longer), _pick(_list(ends), digest, 44))
            out = out.when(kind == f"given:{script}:{gender}", given).when(kind == f"family:{script}:{gender}", family)
    return out


def _group(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other's."""
    return F.when(kind.startswith("given:"), "given").when(kind.startswith("family:"), "family").otherwise(kind)


def draw_surrogates(distinct: DataFrame, key: str) -> DataFrame:
    """``kind, canon, surrogate`` for distinct atoms, all surrogates of a kind distinct and none a real atom."""
    spark = distinct.sparkSession
    real = common.materialize(distinct.select(_group(F.col("kind")).alias("grp"), F.lower("canon").alias("taken")).distinct(), "pii-real")
    todo = distinct.select("kind", "canon")
    done: DataFrame | None = None
    draw = 0
    while True:
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.lit(str(draw))), 512)
        tried = todo.withColumn("digest", digest)
        tried = tried.select("kind", "canon", "digest", _drawn(F.col("kind"), F.col("canon"), F.col("digest"), F.lit(draw)).alias("surrogate"))
        tried = tried.withColumns({"grp": _group(F.col("kind")), "taken": F.lower("surrogate")})
        first = tried.groupBy("grp", "taken").agg(F.min(F.struct("digest", "kind", "canon")).alias("first"))
        free = first.join(real, ["grp", "taken"], "left_anti")
        if done is not None:
            free = free.join(done.select("grp", "taken"), ["grp", "taken"], "left_anti")
        won = free.select(F.col("first.kind").alias("kind"), F.col("first.canon").alias("canon"))
        won = tried.join(won, ["kind", "canon"]).select("kind", "canon", "surrogate", "grp", "taken")
        won = common.materialize(won, "pii-drawn")
        done = won if done is None else done.unionByName(won)
        todo = common.materialize(todo.join(won, ["kind", "canon"], "left_anti"), "pii-again")
        if todo.isEmpty():
            return done.select("kind", "canon", "surrogate")
        draw += 1
        if draw > 60:
            left = todo.count()
            raise RuntimeError(f"{left} entities have no free surrogate of their format in {spark.sparkContext.appName}")


def _into(format_: Column, digits: Column) -> Column:
    """The digits written into the places of the digits of ``format_``, the last of them first."""
    chars = F.split(F.reverse(format_), "")
    backward = F.reverse(digits)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]") & (acc["at"] <= F.length(backward))
        out = F.when(digit, F.substr(backward, acc["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], out).alias("out"), (acc["at"] + F.when(digit, 1).otherwise(0)).alias("at"))

    return F.reverse(F.aggregate(chars, start, put)["out"])


def _cased(like: Column, word: Column) -> Column:
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(word)).otherwise(word)


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """``mention, replacement`` for distinct mentions; of names the words and the surrogates (``parts``)."""
    rows = mentions.withColumn("kind", kind_of(F.col("mention")))
    rows = common.materialize(rows.withColumn("atoms", atoms(F.col("kind"), F.col("mention"))), "pii-mentions")
    each = rows.select(F.explode("atoms").alias("a")).select("a.*").distinct()
    drawn = common.materialize(draw_surrogates(each, key), "pii-surrogates")
    joined = rows.select("mention", "kind", F.posexplode("atoms").alias("pos", "a"))
    joined = joined.join(drawn.select(F.col("kind").alias("akind"), "canon", "surrogate"), (F.col("a.kind") == F.col("akind")) & (F.col("a.canon") == F.col("canon")))
    parts = joined.groupBy("mention", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))).alias("s"))
    m, last = F.col("mention"), F.element_at("s", -1)["surrogate"]
    title = F.regexp_extract(m, rf"^((?:{_ALL_TITLES})\.?\s)", 1)
    bare = F.split(F.regexp_replace(m, rf"^({_ALL_TITLES})\.?\s", ""), r"\s")
    name = F.concat(title, F.array_join(F.zip_with(F.col("s"), bare, lambda x, w: _cased(w, x["surrogate"])), " "))
    text = (
        F.when(F.col("kind").isin("phone", "card", "ssn"), _into(m, last))
        .when(F.col("kind") == "iban", last)
        .when(F.col("kind") == "secret", F.concat(F.regexp_extract(m, rf"^{_SECRET}[\"']?", 0), last, F.regexp_extract(m, _SECRET_END, 0)))
        .when(F.col("kind") == "email", F.concat(F.regexp_extract(m, r"^[._%+-]*", 0), last))
        .when(F.col("kind") == "name", name)
        .otherwise(last)
    )
    own = F.when(F.col("kind") == "name", F.zip_with(bare, F.col("s"), lambda w, x: F.struct(w.alias("word"), x["surrogate"].alias("surrogate"))))
    return parts.select("mention", "kind", text.alias("replacement"), own.alias("parts"))


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text's mentions replaced, and ``n_entities`` (an own column of this name, case
    ignored, goes)."""
    common.prepare(docs.sparkSession)
    names = common.others(docs.columns, ["n_entities"])
    key_of, swap_of, parts_of = (common.spare(names, c) for c in ("__key", "__swap", "__names"))
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    holds = F.coalesce(may_hold(text) & text.rlike(MENTION), F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    # each distinct text once, however often it is repeated
    texts = rows.where(holds).select(F.sha2(text, 256).alias("__key"), F.array_distinct(found).alias("found"))
    texts = common.materialize(texts.groupBy("__key").agg(F.first("found").alias("found")), "pii-texts")
    each = texts.select("__key", F.explode("found").alias("mention"))
    swaps = common.materialize(replacements(each.select("mention").distinct(), key), "pii-replacements")
    swap = F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("__swap")
    by_text = each.join(swaps, "mention").groupBy("__key").agg(swap, F.flatten(F.collect_list("parts")).alias("__parts"))
    # a part of a name, as written or in capitals, to its surrogate (given and family name of one form: the first)
    first = lambda a: F.filter(a, lambda x, i: F.array_position(a["word"], x["word"]) == i + 1)
    spelt = lambda f: F.transform("__parts", lambda x: F.struct(f(x["word"]).alias("word"), _cased(f(x["word"]), x["surrogate"]).alias("surrogate")))
    spellings = F.array_sort(F.array_distinct(F.concat(spelt(lambda w: w), spelt(F.upper), spelt(lambda w: F.when(F.upper(w) == w, F.initcap(w)).otherwise(w)))))
    by_text = by_text.withColumn("__spelt", F.filter(spellings, lambda x: F.length(x["word"]) > 1))
    by_text = by_text.withColumn("__names", F.map_from_entries(first(F.col("__spelt"))))
    by_text = by_text.select(F.col("__key").alias(key_of), F.col("__swap").alias(swap_of), F.col("__names").alias(parts_of))
    held = rows.where(holds).withColumn(key_of, F.sha2(text, 256)).join(by_text, key_of)
    names_of = F.col(parts_of)

    def word(w: Column) -> Column:
        owner = F.regexp_replace(w, r"['’]s$", "")
        return F.coalesce(names_of[w], F.concat(names_of[owner], F.substr(w, F.length(owner) + 1, F.lit(2))), w)

    cut = F.transform(F.split(text, MENTION, -1), lambda x: F.regexp_extract_all(x, F.lit(_WORDS), F.lit(0)))
    again = F.aggregate(cut, F.lit(0), lambda n, x: n + F.size(F.filter(x, lambda w: word(w) != w)))
    named = F.size(names_of) > 0
    between = F.when(named, F.transform(cut, lambda x: F.array_join(F.transform(x, word), ""))).otherwise(F.split(text, MENTION, -1))
    put = F.zip_with(between, F.transform(found, lambda x: F.col(swap_of)[x]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    new = {text_col: F.array_join(put, ""), "n_entities": F.size(found) + F.when(named, again).otherwise(0)}
    swapped = held.select(*[new[c].alias(c) if c == text_col else F.col(f"`{c}`") for c in names], new["n_entities"].alias("n_entities"))
    return swapped.unionByName(rows.where(~holds).withColumn("n_entities", F.lit(0)))
