"""Registered queries of the operators; the contracts' digest columns are derived here."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airseries.llm import align, bpe, decontaminate, html_text, near_dup, piece, sharding, spelling, suffix_dedup, token_counts, toxicity, url_filter, vector_topk
from airseries.llm.common import prepare, table, written  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCAB, PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN
#: The rules of the url query.
RULES = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
         url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"))


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def token_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    vocab = public_tokenizers.path(VOCAB)
    ids = bpe.encode(docs.select("doc_id", "text"), vocab, PATTERN)
    both = bpe.decode(ids, vocab, PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op1_bpe_round_trip")
def op1(spark, sf_dir):
    """Every whole text encoded by the rank file and decoded again."""
    return token_digest(table(spark, sf_dir, "documents"))


@register("op2_html_text")
def op2(spark, sf_dir):
    """The main text of every page."""
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op5_kd_shards")
def op5(spark, sf_dir):
    """All documents in 24 shards of near equal bytes."""
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op6_exact_top_k", """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""")
def op6(spark, sf_dir):
    """The 20 highest integer inner products of every query vector."""
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), 20, divisor=20)


_URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, action, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\b[^>]*>)', 1)) AS tag FROM p WHERE contains(url, '://')),
links AS (
  SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '(?is)http-equiv') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    ELSE regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) END), '&amp;', '&') AS link FROM tags
  WHERE regexp_matches(tag, '(?is)rel\s*=\s*["'']?canonical\b|http-equiv\s*=\s*["'']?refresh\b')),
full_links AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link END AS link FROM links WHERE link <> ''),
keyed AS (
  SELECT regexp_extract(url, '(?s)^([^#]*)', 1) AS u, regexp_extract(link, '(?s)^([^#]*)', 1) AS v FROM full_links WHERE link IS NOT NULL),
edges AS (SELECT u, v FROM keyed WHERE u <> v UNION SELECT v, u FROM keyed WHERE u <> v),
reach AS (SELECT u AS a, u AS b FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
fits AS (
  SELECT b AS url, arg_max(action, length(rule)) AS action FROM (SELECT DISTINCT b FROM reach) JOIN rules
  ON (translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = rhost
      OR ends_with(translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.' || rhost))
   AND starts_with(regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1), rpath) GROUP BY b),
fate AS (SELECT a, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS bad FROM reach JOIN fits ON b = fits.url GROUP BY a),
own AS (
  SELECT page_id, url, host, path, (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule FROM p)
SELECT page_id, host, path, rule, coalesce((SELECT action FROM rules r WHERE r.rule = own.rule), CASE WHEN fate.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN fate ON regexp_extract(own.url, '(?s)^([^#]*)', 1) = fate.a
"""


@register("op9_url_filter", _URL_SQL)
def op9(spark, sf_dir):
    """Every page's url judged by the rules and by its aliases."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Model from the labels whose remainder is not 0."""
    train = table(spark, sf_dir, "labels").where(toxicity.remainder(F.col("doc_id")) != 0)
    return toxicity.fit(docs, train)


@register("op8_toxicity")
def op8(spark, sf_dir):
    """A toxicity score for every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op10_order_minhash")
def op10(spark, sf_dir):
    """The near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS)


def _template_sql(name: str, table_: str, id_: str) -> str:
    return f"""
{name}_raw AS (SELECT DISTINCT {id_}, regexp_extract_all(coalesce(text, ''), '(\\p{{N}}+(?:[.,]\\p{{N}}+)*|[\\p{{L}}\\p{{M}}\\p{{N}}]+)') AS raw
  FROM {table_} WHERE {id_} IS NOT NULL),
{name}_tok AS (SELECT {id_}, raw, list_transform(raw, lambda x, i: CASE WHEN x >= '0' AND x < ':' THEN '<num>'
    WHEN i > 1 AND x IN ({_UNITS}) AND raw[i - 1] >= '0' AND raw[i - 1] < ':' THEN '<unit>'
    WHEN x <> lower(x) THEN '<name>' ELSE x END) AS shape FROM {name}_raw),
{name}_pos AS (SELECT {id_}, raw, shape, unnest(range(1, len(shape) - 3)) AS pos FROM {name}_tok),
{name}_win AS (SELECT {id_}, pos, shape[pos:pos + 4] AS win FROM {name}_pos
  WHERE len(list_filter(shape[pos:pos + 4], lambda x: NOT x IN ('<num>', '<unit>', '<name>'))) >= 2)"""


@register("op7_template_decontamination", f"""
WITH {_template_sql('b', 'benchmark', 'item_id')}, {_template_sql('d', 'documents', 'doc_id')},
total AS (SELECT item_id, count(DISTINCT pos) AS n FROM b_win GROUP BY item_id),
aligned AS (
  SELECT doc_id, item_id, d.pos - b.pos AS shift, count(DISTINCT b.pos) AS matched FROM d_win d JOIN b_win b ON d.win = b.win GROUP BY 1, 2, 3),
hits AS (SELECT doc_id, item_id, shift, matched / n AS similarity FROM aligned JOIN total USING (item_id) WHERE matched >= 0.8 * n - 1e-9),
slots AS (
  SELECT h.*, b.shape[k] AS kind, b.raw[k] AS ours, d.raw[k + shift] AS theirs, d.shape[k + shift] AS there
  FROM (SELECT h.*, unnest(range(1, len(b.shape) + 1)) AS k FROM hits h JOIN b_tok b USING (item_id)) h
  JOIN b_tok b USING (item_id) JOIN d_tok d USING (doc_id) WHERE k + shift >= 1),
used AS (SELECT * FROM slots WHERE kind IN ('<num>', '<unit>', '<name>') AND there = kind),
judged AS (
  SELECT h.doc_id, h.item_id, h.similarity, coalesce(bool_and(u.ours = u.theirs), true) AS verbatim,
    count(DISTINCT CASE WHEN u.ours IS NOT NULL THEN (u.kind, u.ours, u.theirs) END) = count(DISTINCT CASE WHEN u.ours IS NOT NULL THEN (u.kind, u.ours) END) AS ok
  FROM hits h LEFT JOIN used u ON h.doc_id = u.doc_id AND h.item_id = u.item_id AND h.shift = u.shift GROUP BY h.doc_id, h.item_id, h.shift, h.similarity)
SELECT doc_id, item_id, max(similarity) AS similarity, bool_or(verbatim) AS verbatim FROM judged WHERE ok GROUP BY 1, 2
""")
def op7(spark, sf_dir):
    """The (document, benchmark item) pairs that share a template."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substr(h, 1024 * k + 1, 1122) AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 1023) // 1024)) AS k FROM d)),
p AS (SELECT doc_id, k, part, unnest(range(0, least(512, length(part) // 2))) AS j FROM c),
w AS (SELECT doc_id, 512 * k + j AS i, substr(part, 2 * j + 1, 2) AS b,
        CASE WHEN 2 * j + 100 <= length(part) THEN substr(part, 2 * j + 1, 100) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS lo FROM w WHERE s IS NOT NULL GROUP BY s),
m AS (SELECT w.doc_id, w.i, w.b, max(CASE WHEN f.lo < w.doc_id THEN 1 ELSE 0 END)
        OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN f ON w.s = f.s),
g AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m),
r AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, count(*) FILTER (gone = 1 AND before = 0) AS spans,
        string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
""")
def op3(spark, sf_dir):
    """The bytes of every text that an earlier document has too, removed."""
    out = suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


#: Three edits of every document, at places its doc_id decides: a passage of its own is
#: inserted, some characters go, some are replaced.
EDITS_SQL = """transform(sequence(0, 2), k -> struct(
    CAST(pmod(xxhash64(doc_id, k), length(text) + 1) AS INT) AS start,
    IF(k = 0, 0, 3 + 4 * k) AS length,
    CASE k WHEN 0 THEN substring(text, CAST(pmod(xxhash64(doc_id, 7), length(text) + 1) AS INT), 30)
        WHEN 1 THEN '' ELSE concat('-', substring(text, 1, 5)) END AS text))"""


@register("op4_edit_counts")
def op4(spark, sf_dir):
    """Token counts of every document, before and after three edits."""
    vocab = public_tokenizers.path(VOCAB)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    state = token_counts.build(docs.withColumn("edits", F.expr(EDITS_SQL)).select("doc_id", "edits", "text"), vocab, PATTERN)
    after = token_counts.apply_listed(state, vocab, PATTERN)
    return after.select("doc_id", F.col("n_before").alias("n_tokens_before"), F.col("n_tokens").alias("n_tokens_after"),
                        "n_encoded", (F.octet_length("lens") / 4).cast("long").alias("n_pretokens"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))


PIECES = "piece_bpe_32k.model"


@register("op11_sentencepiece")
def op11(spark, sf_dir):
    """Every whole text encoded by the merge-type model, with an end id, and decoded again."""
    model = public_tokenizers.path(PIECES)
    ids = piece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, end=True)
    both = piece.decode(ids, model)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op12_spelling_variants", """
WITH RECURSIVE t AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs
  WHERE length(run) >= 7 GROUP BY ALL),
keyed AS (SELECT run, n, hex(encode(doc || ':' || run)) AS hx FROM low),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(hx) // 2),
      lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM keyed, t),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN w ON c.s = w.word UNION SELECT w.word, c.word FROM cut c JOIN w ON c.s = w.word),
ranked AS (
  SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS r FROM near JOIN w ON near.other = w.word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
    CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN ranked ON w.word = ranked.word AND r = 1),
walk AS (
  SELECT word, word AS at, form AS nxt FROM told
  UNION ALL SELECT walk.word, walk.nxt, told.form FROM walk JOIN told ON walk.nxt = told.word)
SELECT told.word, form, walk.at AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM told JOIN walk ON told.word = walk.word AND walk.nxt IS NULL
""")
def op12(spark, sf_dir):
    """Every repeated word with its near words, its form and its root."""
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


@register("op13_token_alignment")
def op13(spark, sf_dir):
    """Every document's token groups and links under two tokenizers, with the links' corpus-wide counts."""
    out = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                      PATTERN, public_tokenizers.path(PIECES), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
