"""The registered queries of the corpus operators: each reads its whole table, applies
the operator with production parameters, and shapes the result to the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, eftrie, htmltext, jaccard, knmodel, packing, prefixtrie, runs, suffixes, surrogates, topk, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {
        "vocabulary": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens (minimum bin slack)."""
    packed = packing.pack(common.read_table(spark, sf_dir, "documents"), **vocabulary())
    return packed.withColumnRenamed("id", "doc_id")


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9."""
    return jaccard.link(common.read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The key of the registered query; a deployment passes its own secret.
PII_KEY = "registered-query"


@query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by consistent surrogates."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, PII_KEY).select("doc_id", "text", "n_entities")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under its language's model of trusted text, and the verdict."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = knmodel.classify(docs, common.read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside 13-word windows of the benchmark (winnowing)."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), "contaminated",
    )


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into seekable bundles, and read back."""
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = common.shared_folder(common.prepare(spark), "warc")
    index = warc.write(pages, folder)
    return warc.read(index, folder, payloads=False).select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


ORACLES["op2_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS r FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r IS NULL OR r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r <> page_id THEN r END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)"""


#: The site rules of the contract.
SITE_RULES = (
    urlfilter.site_rule("block", "net/"), urlfilter.site_rule("allow", "example.net/en/"),
    urlfilter.site_rule("block", "example.com/de/"), urlfilter.site_rule("allow", "org/fr/"),
)


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the site rules, then by the pattern rules."""
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.filter_urls(pages, SITE_RULES + urlfilter.DEFAULT_TERMS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest integer inner products of every vector whose id is divisible by 100."""
    found = topk.top_k(common.read_table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the n-gram trie of four fifths of them."""
    scored = eftrie.score(common.read_table(spark, sf_dir, "documents"), min_count=1, least=1, order=3)  # nothing counted is dropped
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page (conditional random field over leaf blocks)."""
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract_text(pages).select("page_id", "url", "text", "n_chars")


_URL_WORDS = "|".join("[^a-z0-9]".join(t.tokens) for t in urlfilter.DEFAULT_TERMS)

ORACLES["op3_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, low, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(low, '(^|[^a-z0-9])({_URL_WORDS})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

ORACLES["op7_topk_search"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.nth, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.nth <> c.nth
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes inside 50-byte strings of earlier documents (depth-limited radix sort)."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return suffixes.dedup(docs).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLES["op11_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n_bytes, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT r, doc_id, p, b[p + 1 : p + 50] AS s FROM (SELECT r, doc_id, b, unnest(range(0, n_bytes - 49)) AS p FROM d)
), first AS (
  SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id) OR count(doc_id) < count(*)
), gone AS (
  SELECT r, p FROM w JOIN first USING (s) WHERE m < doc_id OR doc_id IS NULL AND m IS NOT NULL
), runs AS (
  SELECT r, min(p) AS a, max(p) + 50 AS z FROM (
    SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM (
      SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone))
  GROUP BY r, g
), per AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM runs GROUP BY r
), held AS (
  SELECT r, string_agg(hex(b[prev + 1 : a]), '' ORDER BY a) AS h FROM (
    SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM runs) JOIN d USING (r) GROUP BY r
)
SELECT d.doc_id, d.n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(coalesce(unhex(held.h || hex(b[last + 1 : n_bytes])), b)) AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN held USING (r)"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words and the text without their repetitions (recompression); a tenth of the
    texts is made periodic first, as the contract says."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.detect(docs, rewrite=runs.periodic_copy)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"]))), F.lit(0))
    longest = found.withColumn("longest", longest)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return longest.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"), F.col("longest.period").alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def rebuilt(convs: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of the conversation at the hundred, then the own turns after h."""
    h = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    heads = convs.where("conv % 100 = 0").select(F.col("conv").alias("hundred"), F.slice("turns", 1, 5).alias("head"))
    both = convs.join(heads, F.col("hundred") == F.col("conv") - F.col("conv") % 100, "left")
    head = F.coalesce("head", F.slice("turns", 1, 0))
    return both.select("conv", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations (range minima over sorted LCPs)."""
    turns = common.read_table(common.prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixtrie.trie(rebuilt(prefixtrie.sequences(turns)))


ORACLES["op12_conversation_trie"] = """
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS c,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'k': k, 'c': c} ORDER BY turn NULLS FIRST, k) AS turns FROM t GROUP BY conv_id
), bits AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT conv_id, turns, list_transform(range(0, 8 * length(CAST(conv_id AS VARCHAR))),
    lambda b: (ord(substr(CAST(conv_id AS VARCHAR), CAST(b // 8 + 1 AS INTEGER), 1)) >> CAST(b % 8 AS INTEGER)) & 1) AS b FROM own
), hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)),
    lambda crc, x: xor(crc >> 1, 3988292384 * (xor(crc, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM bits
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, o.turns[1:0])[1:o.h], o.turns[o.h + 1:]) AS s
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), steps AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built
), nodes AS (
  SELECT list_transform(s[1:d], lambda x: x.k) AS p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(any_value(s[d].c), 0) AS c, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM steps GROUP BY 1
), kids AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)
), under AS (
  SELECT p[1:up] AS p, sum(n_leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
    SELECT p, unnest(range(0, depth + 1)) AS up, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS n_leaf, (n_convs - 1) * c AS saved FROM counted)
  GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN under USING (p) LEFT JOIN counted u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]"""
