"""The ten queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, chat, licenses, mixing, pii, quality, simhash, toxicity, urls, webp
from veilframe.llm.shared import spread, table

TOKENIZER = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", webp.stored_texts(docs).alias("m")).select("doc_id", "m.*")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    shared = bpe.load(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, shared)


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir, "doc_id", "text"))


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_documents(spark, sf_dir, "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is taken as chosen, 2k + 1 as rejected."""
    turns = table(spark, sf_dir, "conversations")
    return chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0)


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    found = docs.select("doc_id", pii.pii_spans(docs).alias("p"))
    count = lambda kind: F.size(F.filter("p.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    every = F.concat("p.base", "p.added")
    n_spans = F.size(every).cast("long")
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("p.base")), 256).alias("base_sha256"), pii.span_text(every).alias("spans"), n_spans.alias("n_spans"), (n_spans > 0).alias("has_personal_data"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_webp_media": op2_webp_media,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_rules": op4_license_rules,
    "op5_adaptive_quality": op5_adaptive_quality,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_preference_chat": op7_preference_chat,
    "op8_url_rules": op8_url_rules,
    "op9_toxicity_kneser_ney": op9_toxicity_kneser_ney,
    "op10_pii_semi_markov": op10_pii_semi_markov,
}

_OP4 = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p AS (SELECT * FROM (VALUES (['gnu','general','public','license'], 'gpl'), (['apache','license'], 'apache'), (['cc','by'], 'cc-by'), (['mit','license'], 'mit')) t(ph, label)),
hit AS (SELECT w.r, p.label, i - 1 AS pos FROM w, p, unnest(range(1, len(ws) + 1)) u(i) WHERE ws[i] = ph[1] AND list_slice(ws, i, i + len(ph) - 1) = ph)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels
FROM w LEFT JOIN (SELECT r, count(*) AS n, CAST(min(pos) AS BIGINT) AS lo, CAST(max(pos) AS BIGINT) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r) h USING (r)
"""

_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM d, unnest(range(1, len(ws) - 3)) u(i) WHERE len(ws) >= 5),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
lines AS (SELECT r, line FROM d, unnest(string_split(text, chr(10))) u(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM lines GROUP BY r),
m AS (
  SELECT d.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    {'symbols': CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END, 'repeats': CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END,
     'dup_lines': CASE WHEN n_words > 0 THEN n_dup_lines * 10000 // n_words ELSE 0 END, 'word_length': CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END} AS x FROM m),
v AS (
  SELECT lang, source, measure, CASE WHEN x < 32 THEN x ELSE (x >> sh) << sh END AS b
  FROM (SELECT lang, source, measure, x, greatest(length(ltrim(bin(x), '0')) - 5, 0) AS sh
    FROM (SELECT lang, source, unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) AS measure, unnest([x.symbols, x.repeats, x.dup_lines, x.word_length]) AS x FROM f WHERE NOT base_failed))),
q0 AS (SELECT lang, source, measure, max(n) AS n, min(b) FILTER (4 * up >= n) AS q1, min(b) FILTER (4 * up >= 3 * n) AS q3 FROM
  (SELECT *, count(*) OVER (PARTITION BY lang, source, measure) AS n, count(*) OVER (PARTITION BY lang, source, measure ORDER BY b) AS up FROM v) GROUP BY ALL),
q1 AS (SELECT lang, measure, max(n) AS n, min(b) FILTER (4 * up >= n) AS q1, min(b) FILTER (4 * up >= 3 * n) AS q3 FROM
  (SELECT *, count(*) OVER (PARTITION BY lang, measure) AS n, count(*) OVER (PARTITION BY lang, measure ORDER BY b) AS up FROM v) GROUP BY ALL),
q2 AS (SELECT measure, max(n) AS n, min(b) FILTER (4 * up >= n) AS q1, min(b) FILTER (4 * up >= 3 * n) AS q3 FROM
  (SELECT *, count(*) OVER (PARTITION BY measure) AS n, count(*) OVER (PARTITION BY measure ORDER BY b) AS up FROM v) GROUP BY ALL),
fence AS (
  SELECT lang, source, measure, lo - width AS low, hi + width AS high FROM (
    SELECT *, 8 * greatest(hi - lo, CASE measure WHEN 'symbols' THEN 25 WHEN 'repeats' THEN 10 WHEN 'dup_lines' THEN 10 ELSE 300 END) AS width FROM (
      SELECT a.lang, a.source, a.measure, CASE WHEN a.n >= 50 THEN a.q1 WHEN b.n >= 50 THEN b.q1 ELSE c.q1 END AS lo, CASE WHEN a.n >= 50 THEN a.q3 WHEN b.n >= 50 THEN b.q3 ELSE c.q3 END AS hi
      FROM q0 a JOIN q1 b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN q2 c ON a.measure = c.measure))),
wide AS (SELECT lang, source, max(high) FILTER (measure = 'symbols') AS s, max(high) FILTER (measure = 'repeats') AS p, max(high) FILTER (measure = 'dup_lines') AS l,
  max(high) FILTER (measure = 'word_length') AS wh, max(low) FILTER (measure = 'word_length') AS wl FROM fence GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(x.symbols <= s AND x.repeats <= p AND x.dup_lines <= l AND x.word_length <= wh AND x.word_length >= wl, false) AS kept
FROM f LEFT JOIN wide ON f.lang IS NOT DISTINCT FROM wide.lang AND f.source IS NOT DISTINCT FROM wide.source
"""

_OP7 = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT pair_id, side, max(k) AS n FROM t GROUP BY ALL),
p AS (SELECT a.pair_id, a.n AS nc, b.n AS nr FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1),
other AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.k, b.k)) AS k FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
c AS (SELECT p.*, coalesce(other.k - 1, nc) AS n_common FROM p LEFT JOIN other USING (pair_id)),
r AS (SELECT t.*, n_common, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS tail FROM t JOIN c USING (pair_id)),
o AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY pair_id, side ORDER BY k) - length(tail) AS start FROM r WHERE k > n_common)
SELECT c.pair_id, CAST(n_common AS BIGINT) AS n_common, CAST(nc AS BIGINT) AS n_chosen, CAST(nr AS BIGINT) AS n_rejected,
  coalesce((SELECT string_agg(head || tail, '' ORDER BY k) FROM r WHERE r.pair_id = c.pair_id AND side = 0 AND k <= r.n_common), '') AS prompt,
  coalesce((SELECT string_agg(head || tail, '' ORDER BY k) FROM o WHERE o.pair_id = c.pair_id AND side = 0), '') AS chosen,
  coalesce((SELECT string_agg(head || tail, '' ORDER BY k) FROM o WHERE o.pair_id = c.pair_id AND side = 1), '') AS rejected,
  coalesce((SELECT string_agg(start || ':' || (start + length(tail)), ',' ORDER BY k) FROM o WHERE o.pair_id = c.pair_id AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(start || ':' || (start + length(tail)), ',' ORDER BY k) FROM o WHERE o.pair_id = c.pair_id AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM c
"""

_OP8 = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(h, p, a)),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS a FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op5_adaptive_quality": _OP5, "op7_preference_chat": _OP7, "op8_url_rules": _OP8}
#: The base columns of operator 4, whose rules are regular expressions that SQL's dialect does not have.
OP4_BASE_SQL = _OP4
