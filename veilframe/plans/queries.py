"""Queries over the driver's tables, one or more for each operator family, with equivalent SQL.

Every query reads its whole tables. Where a query needs a second snapshot, a policy or a graph, it derives it from the
tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import chunks, diffs, graph, incremental, paths, policy, render, review, search, symbols, transactions, vectors, verify
from veilframe.sources.scratch import materialize, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SALT = "corpus"
#: The policy of the text queries: no alias holds a term and no term's end begins another, so SQL may replace term by term.
POLICY = [("dictionary", "the", "fen"), ("dictionary", "ation", "mork"), ("denylist", "ing", None), ("alias-registry", "ing", "usk"), ("allowlist", "und", None), ("denylist", "Und", None)]
#: A policy with something wrong of every sort.
FAULTY = [("dictionary", "harbor_mill", "widget"), ("dictionary", "wrenlocke", "wid_get"), ("denylist", "!?", None), ("dictionary", "quietcorp", "not ok"), ("alias-registry", "north", "northwind"), ("denylist", "gull", None)]
PAIRS = [("example.com", "host.invalid"), ("mail1.example.com", "relay.invalid"), ("Apache License", "LICENSE-A"), ("Apache License, Version 2.0", "LICENSE-A2"), ("the", "THE")]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _terms(spark: SparkSession) -> list:
    return policy.collect_terms(policy.term_table(policy.entries(spark, POLICY), SALT))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render(spread(_docs(spark, sf_dir).select("doc_id", "text")), _terms(spark))


def _replaced_sql(column: str) -> str:
    """SQL that replaces the terms of ``POLICY`` one after the other, in each casing."""
    out = column
    for raw, alias in (("the", "fen"), ("ation", "mork"), ("ing", "usk")):
        upper, free = "_*".join(raw.upper()), "_*".join(f"[{c}{c.upper()}]" for c in raw)
        for pattern, new in (("_*".join(raw), alias), (upper, alias.upper()), (raw[0].upper() + "_*" + "_*".join(f"[{c}{c.upper()}]" for c in raw[1:]), alias.capitalize()), (free, alias)):
            out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


_ANY = "[tT]_*[hH]_*[eE]|[aA]_*[tT]_*[iI]_*[oO]_*[nN]|[iI]_*[nN]_*[gG]"

# -- text and terms -------------------------------------------------------------------------------------------


@query("word_runs", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS BIGINT) AS n_runs, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS BIGINT) AS n_distinct, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _docs(spark, sf_dir).select("doc_id", "text", T.runs(F.col("text")).alias("r"))
    return cut.select("doc_id", F.size("r").cast("long").alias("n_runs"), F.size(F.array_distinct("r")).cast("long").alias("n_distinct"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("term_hits", "SELECT doc_id, term, CAST(len(regexp_extract_all(text, p)) AS BIGINT) AS hits FROM documents, (VALUES ('the', '[tT]_*[hH]_*[eE]'), ('ation', '[aA]_*[tT]_*[iI]_*[oO]_*[nN]'), ('ing', '[iI]_*[nN]_*[gG]')) t(term, p) WHERE len(regexp_extract_all(text, p)) > 0")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.term_hits(_docs(spark, sf_dir), _terms(spark))


@query("term_table", "SELECT * FROM (VALUES ('the', 'the', 'fen', 'dictionary'), ('ation', 'ation', 'mork', 'dictionary'), ('ing', 'ing', 'usk', 'alias-registry')) t(raw, normalized, replacement, policy_source)")
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.term_table(policy.entries(spark, POLICY), SALT)


@query("policy_violations", "SELECT * FROM (VALUES ('unmatchable term', '!?', NULL), ('unmatchable alias', 'quietcorp', 'not ok'), ('shared alias', 'wrenlocke', 'harbor_mill'), ('alias holds a term', 'north', 'north')) t(\"check\", raw, other)")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_violations(policy.entries(spark, FAULTY), SALT)


@query("case_adapt", """SELECT run, CASE WHEN NOT regexp_matches(run, '[A-Za-z]') THEN 'neutral_Word' WHEN NOT regexp_matches(run, '[a-z]') THEN 'NEUTRAL_WORD' WHEN NOT regexp_matches(run, '[A-Z]') THEN 'neutral_word'
  WHEN regexp_matches(run, '^[A-Z]') THEN 'Neutral_Word' ELSE 'neutral_Word' END AS adapted, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS run FROM documents) GROUP BY run""")
def case_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select(F.explode(T.runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return found.select("run", T.adapt_case(F.col("run"), F.lit("neutral-Word")).alias("adapted"), "n")


@query("derived_alias", "SELECT n_name, 'sym_' || substr(sha256('corpus:' || n_name), 1, 8) AS alias, lower(n_name) || '_' || substr(sha256('corpus:' || n_name), 1, 4) AS stemmed FROM nation")
def derived_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", T.derive_alias(F.col("n_name"), SALT).alias("alias"), T.derive_stemmed_alias(F.col("n_name"), F.lower("n_name"), SALT).alias("stemmed"))


@query("normalized_names", "SELECT c_name, replace(replace(lower(c_name), '_', ''), '-', '') AS normalized, regexp_matches(c_name, '^[A-Za-z0-9_]+$') AS matchable FROM customer")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_name", T.normalize_term(F.col("c_name")).alias("normalized"), T.is_run(F.col("c_name")).alias("matchable"))


@query("identifier_tokens", """SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[a-z0-9]+'))) AS tokens
  FROM (SELECT p_partkey, replace(p_type, ' ', '') || p_brand || p_name AS name FROM part)""")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.identifier_tokens(F.concat(F.replace("p_type", F.lit(" "), F.lit("")), "p_brand", "p_name")).alias("tokens"))


@query("whole_word_replace", "SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: x = 'the')) AS BIGINT) AS n, sha256(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x: CASE WHEN x = 'the' THEN 'fen' ELSE x END), '')) AS digest FROM documents")
def whole_word_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.count_word(F.col("text"), "the").alias("n"), F.sha2(T.replace_word(F.col("text"), "the", "fen"), 256).alias("digest"))


@query("redact_longest", r"""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, 'Apache License, Version 2.0', 'LICENSE-A2'), 'Apache License', 'LICENSE-A'), 'mail1.example.com', 'relay.invalid'), 'example.com', 'host.invalid'), 'the', 'THE')) AS digest FROM documents""")
def redact_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(render.replace_longest(F.col("text"), PAIRS), 256).alias("digest"))


@query("line_facts", """SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_ends, chr(10) AS eol FROM documents""")
def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"), F.regexp_count("text", F.lit("\n")).cast("long").alias("n_ends"), T.dominant_eol(F.col("text")).alias("eol"))


# -- rendering ------------------------------------------------------------------------------------------------


@query("render_hash", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_ANY}')) AS BIGINT) AS n_replacements, CAST(strlen(text) AS BIGINT) AS original_bytes, CAST(strlen({_replaced_sql('text')}) AS BIGINT) AS rendered_bytes, sha256({_replaced_sql('text')}) AS rendered_sha256 FROM documents")
def render_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select("doc_id", F.size("map.replacements").cast("long").alias("n_replacements"), F.octet_length("text").cast("long").alias("original_bytes"), F.octet_length("map.rendered").cast("long").alias("rendered_bytes"), F.sha2("map.rendered", 256).alias("rendered_sha256"))


_PARTS = f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_ANY}') AS hit, string_split_regex(text, '{_ANY}') AS gap FROM documents),
 u AS (SELECT doc_id, i, hit[i] AS original_text, {_replaced_sql('hit[i]')} AS sanitized_text, gap[i] AS gap FROM m, unnest(range(1, len(hit) + 1)) t(i)),
 s AS (SELECT *, CAST(sum(strlen(gap) + strlen(original_text)) OVER w - strlen(original_text) AS BIGINT) AS original_start, CAST(sum(strlen(gap) + strlen(sanitized_text)) OVER w - strlen(sanitized_text) AS BIGINT) AS sanitized_start FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


@query("span_map", _PARTS + " SELECT doc_id, CAST(i - 1 AS BIGINT) AS id, original_text, sanitized_text, original_start, sanitized_start FROM s")
def span_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    return render.replacements_of(docs, _terms(spark)).select("doc_id", "id", "original_text", "sanitized_text", "original_start", "sanitized_start")


@query("running_offsets", _PARTS + " SELECT doc_id, CAST(i - 1 AS BIGINT) AS id, sanitized_start AS shifted_start, true AS same FROM s")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = render.running_offsets(materialize(render.audit(_rendered(spark, sf_dir)), "audit"))
    return listed.select("doc_id", "id", F.col("shifted_start").cast("long").alias("shifted_start"), (F.col("shifted_start") == F.col("sanitized_start")).alias("same"))


@query("span_tiling", "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_faults FROM documents")
def span_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize(_rendered(spark, sf_dir), "renders")
    both = made.select(F.lit(1).alias("d"), F.lit(0).alias("f")).unionByName(render.tiling_faults(made).select(F.lit(0).alias("d"), F.lit(1).alias("f")))
    return both.agg(F.sum("d").alias("n_documents"), F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("n_faults"))


@query("reverse_roundtrip", "SELECT doc_id, sha256(text) AS digest FROM documents")
def reverse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _rendered(spark, sf_dir)
    return made.select("doc_id", F.sha2(render.reverse(made), 256).alias("digest"))


@query("leak_scan", "SELECT term, CAST(sum(len(regexp_extract_all(text, p))) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_after FROM documents, (VALUES ('the', '[tT]_*[hH]_*[eE]'), ('ation', '[aA]_*[tT]_*[iI]_*[oO]_*[nN]'), ('ing', '[iI]_*[nN]_*[gG]')) t(term, p) GROUP BY term")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, docs = _terms(spark), spread(_docs(spark, sf_dir).select("doc_id", "text"))
    before = render.leaks(docs, terms, "text").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    after = render.leaks(docs.select("doc_id", render.replace_terms(docs, terms).alias("rendered")), terms, "rendered").groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    return before.join(after, "term", "left").select("term", "n", F.coalesce("k", F.lit(0)).cast("long").alias("n_after"))


@query("alias_collisions", "SELECT DISTINCT doc_id, run, alias AS replacement FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS run FROM documents), (VALUES ('than'), ('was')) t(alias) WHERE replace(lower(run), '_', '') = alias")
def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = policy.term_table(policy.entries(spark, [("dictionary", "quux", "than"), ("dictionary", "corge", "was")]), SALT)
    return render.alias_collisions(_docs(spark, sf_dir), terms)


_LINE_BEFORE = "regexp_extract(array_to_string(list_transform(range(1, i + 1), lambda k: CASE WHEN k < i THEN hits[2 * k - 1] || hits[2 * k] ELSE hits[2 * k - 1] END), ''), '[^\\n]*$')"
_ZONES = _PARTS.replace(" u AS (", " z AS (SELECT doc_id, list_concat(flatten(list_transform(range(1, len(hit) + 1), lambda k: [gap[k], hit[k]])), ['']) AS hits FROM m),\n u AS (")


@query("audit", _ZONES + f", l AS (SELECT doc_id, i, lower(original_text) AS term, {_LINE_BEFORE} AS line FROM s JOIN z USING (doc_id)) SELECT term, CASE WHEN regexp_matches(line, '//|#') THEN 'comment' ELSE 'identifier' END AS category, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM l GROUP BY ALL")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements by term and zone: in texts without a language what stands behind ``//`` or ``#`` on a line is a comment."""
    listed = render.replacements_of(spread(_docs(spark, sf_dir).select("doc_id", "text")), _terms(spark))
    return listed.groupBy(F.lower("original_text").alias("term"), "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_documents"))


@query("verify_renders", "SELECT CAST('collision' AS VARCHAR) AS \"check\", count(*) AS n FROM (SELECT DISTINCT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS run FROM documents) WHERE replace(lower(run), '_', '') IN ('fen', 'mork', 'usk')) HAVING count(*) > 0")
def verify_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = policy.term_table(policy.entries(spark, POLICY), SALT)
    made = materialize(_rendered(spark, sf_dir), "renders")
    return verify.verify_renders(made, policy.collect_terms(known), known).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


_MARKS = "('use','import','from','mod','package','require','pub','export','crate','extern','include','using')"
_KEYS = "(" + ",".join(f"'{k}'" for k in T.KEYWORDS) + ")"
_PROTECTED = f"""WITH l AS (SELECT row_number() OVER () AS d, text FROM conversations), x AS (SELECT d, i, string_split(text, chr(10))[i] AS line FROM l, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
 r AS (SELECT d, i, k, regexp_extract_all(line, '[A-Za-z0-9_]+')[k] AS run FROM x, unnest(range(1, len(regexp_extract_all(line, '[A-Za-z0-9_]+')) + 1)) t(k)),
 m AS (SELECT *, max(CAST(run IN {_MARKS} AND k <= 2 AS INT)) OVER (PARTITION BY d, i) AS lead, max(CAST(run IN {_MARKS} AS INT)) OVER (PARTITION BY d, i ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS near FROM r),
 n AS (SELECT DISTINCT run AS name FROM m WHERE run NOT IN {_KEYS} AND (lead = 1 OR near = 1 OR run LIKE '\\_\\_%' ESCAPE '\\'))"""


@query("protected_union", _PROTECTED + " SELECT name FROM n")
def protected_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.protected_union(table(spark, sf_dir, "conversations"), F.lit("text"))


@query("protected_conflicts", _PROTECTED + " SELECT name, term FROM n, (VALUES ('onth'), ('ation')) t(term) WHERE contains(replace(lower(name), '_', ''), term)")
def protected_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = policy.collect_terms(policy.term_table(policy.entries(spark, [("denylist", "onth", None), ("denylist", "ation", None)]), SALT))
    return render.protected_conflicts(render.protected_union(table(spark, sf_dir, "conversations"), F.lit("text")), terms)


# -- incremental ----------------------------------------------------------------------------------------------


def _before(docs: DataFrame) -> DataFrame:
    """An earlier snapshot: German texts were other, Spanish ones were not there, French ones had a twin that has gone since."""
    old = docs.where("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old.unionByName(docs.where("lang = 'fr'").withColumn("doc_id", F.col("doc_id") + 1_000_000_000_000))


_OUTCOMES = "SELECT doc_id, CASE lang WHEN 'es' THEN 'new' WHEN 'de' THEN 'changed' ELSE 'unchanged' END AS outcome FROM documents UNION ALL SELECT doc_id + 1000000000000, 'removed' FROM documents WHERE lang = 'fr'"


@query("doc_fingerprints", "SELECT doc_id, sha256(coalesce(text, chr(1)) || chr(0) || coalesce(lang, chr(1))) AS fingerprint FROM documents")
def doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.with_fingerprint(_docs(spark, sf_dir), "text", "lang").select("doc_id", "fingerprint")


@query("corpus_fingerprint", "SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS corpus_fingerprint FROM (SELECT doc_id % 1024 AS b, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id, sha256(text))) AS d FROM documents GROUP BY 1)")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.corpus_fingerprint(_docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("fingerprint")))


@query("incremental_diff", _OUTCOMES)
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    printed = lambda d: incremental.with_fingerprint(d, "text").select("doc_id", "fingerprint")
    return incremental.changes(printed(_before(docs)), printed(docs))


@query("index_pass", f"SELECT doc_id, sha256({_replaced_sql('text')}) AS rendered_sha256 FROM documents")
def index_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms = _docs(spark, sf_dir).select("doc_id", "lang", "text"), _terms(spark)
    made = lambda d: d.select("doc_id", "fingerprint", F.sha2(render.replace_terms(d, terms), 256).alias("rendered_sha256"))
    printed = lambda d: incremental.with_fingerprint(d, "text")
    state = materialize(made(printed(_before(docs))), "index-state")
    after, _ = incremental.index_pass(state, printed(docs), made)
    return after.select("doc_id", "rendered_sha256")


@query("stale_sweep", "SELECT doc_id + 1000000000000 AS doc_id FROM documents WHERE lang = 'fr'")
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return verify.orphans(_before(docs).select("doc_id"), docs, "doc_id")


@query("pending_edits", "SELECT doc_id, CASE lang WHEN 'de' THEN 'pending' WHEN 'fr' THEN 'missing' WHEN 'es' THEN 'stale' ELSE 'converged' END AS outcome FROM documents")
def pending_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    older = F.concat("text", F.lit("?"))
    state = docs.select("doc_id", F.sha2(F.when(F.col("lang") == "es", older).otherwise(F.col("text")), 256).alias("rendered_hash"), F.col("text").alias("fresh"))
    mirror = docs.where("lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).when(F.col("lang") == "es", older).otherwise(F.col("text")).alias("present"))
    return incremental.pending_edits(state, mirror)


@query("merge_snapshot", "SELECT doc_id, sha256(text) AS digest FROM documents UNION ALL SELECT doc_id + 1000000000000, sha256(text) FROM documents WHERE lang = 'fr'")
def merge_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    merged = incremental.merge(_before(docs), docs.where("lang IN ('de', 'es')"), docs.where("false"))
    return merged.select("doc_id", F.sha2("text", 256).alias("digest"))


# -- paths ----------------------------------------------------------------------------------------------------

_PATH = "regexp_extract(url, '://([^?#]*[^?#/])', 1)"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*[^?#/])", 1).alias("path"))


_PROJECT = f"WITH p AS (SELECT page_id, {_PATH} AS path, regexp_extract({_PATH}, '(?:^|/)[^/]+(\\.[^./]*)$', 1) AS suffix FROM pages), q AS (SELECT page_id, path, {_replaced_sql('substr(path, 1, length(path) - length(suffix))')} || suffix AS projected FROM p)"


@query("path_project", _PROJECT + " SELECT page_id, path, projected FROM q")
def path_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.project_paths(_page_paths(spark, sf_dir), _terms(spark))


@query("path_collisions", """WITH p AS (SELECT DISTINCT list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(string_split(path, '/')[1:n], '/')) AS pre, path FROM (SELECT regexp_extract(url, '://([^?#]*[^?#/])', 1) AS path FROM pages)),
 e AS (SELECT DISTINCT unnest(pre) AS real, path FROM p), k AS (SELECT DISTINCT real, real = path AS is_file FROM e),
 j AS (SELECT DISTINCT real, is_file, regexp_replace(real, '[0-9]+', '0', 'g') AS projected FROM k) SELECT lower(projected) AS key, count(*) AS n FROM j GROUP BY 1 HAVING count(*) > 1""")
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = _page_paths(spark, sf_dir).withColumn("projected", F.regexp_replace("path", "[0-9]+", "0"))
    return paths.path_collisions(paths.path_map(coarse))


@query("path_prefix_lookup", _PROJECT + f", r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM q) SELECT {_replaced_sql('dir')} || '/new/leaf' AS asked, dir || '/new/leaf' AS real FROM r")
def path_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = paths.project_paths(_page_paths(spark, sf_dir), _terms(spark))
    asked = projected.select(F.concat(F.regexp_replace("projected", "/[^/]*$", ""), F.lit("/new/leaf")).alias("asked"))
    return paths.resolve_new(asked, paths.path_map(projected))


@query("path_resolve", _PROJECT + " SELECT DISTINCT projected AS asked, path AS real FROM q")
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = paths.project_paths(_page_paths(spark, sf_dir), _terms(spark))
    return paths.resolve(projected.select(F.col("projected").alias("asked")).distinct(), paths.path_map(projected))


@query("glob_list", f"SELECT page_id, {_PATH} AS path, regexp_matches(regexp_extract({_PATH}, '[^/]*$'), '^[^/]*\\.html$') AS by_name, regexp_matches({_PATH}, '^(?:[^/]*/)*en/[4-7][^/]*$') AS by_path FROM pages")
def glob_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).select("page_id", "path", T.matches_glob(F.col("path"), "*.html").alias("by_name"), T.matches_glob(F.col("path"), "**/en/[4-7]*").alias("by_path"))


@query("path_labels", f"SELECT page_id, CASE WHEN suffix = 'md' THEN 'markdown' WHEN suffix = 'py' THEN 'python' WHEN suffix = 'rs' THEN 'rust' ELSE 'text' END AS language, CASE WHEN list_contains(string_split(path, '/'), 'de') THEN 'vendor' ELSE 'owned' END AS origin, path AS safe FROM (SELECT page_id, {_PATH} AS path, (['md', 'py', 'rs', 'html'])[1 + page_id % 4] AS suffix FROM pages)")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _page_paths(spark, sf_dir).withColumn("named", F.concat("path", F.lit("."), F.element_at(F.array(*map(F.lit, ("md", "py", "rs", "html"))), (F.col("page_id") % 4 + 1).cast("int"))))
    moved = F.regexp_replace("path", "/de/", "/vendor/")
    return p.select("page_id", T.language_of(F.col("named")).alias("language"), T.origin_of(moved).alias("origin"), T.safe_path(F.concat(F.lit("./"), F.col("path"))).alias("safe"))


# -- search, chunks, vectors ----------------------------------------------------------------------------------


_SEARCH = """WITH l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS line_text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) WHERE contains(text, 'ation')),
 p AS (SELECT doc_id, line, line_text, string_split(line_text, 'ation') AS parts FROM l WHERE contains(line_text, 'ation')),
 s AS (SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * 5 + 1 AS BIGINT) AS "column", line_text FROM p, unnest(range(1, len(parts))) t(k))"""


@query("substring_search", _SEARCH + " SELECT * FROM s")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_docs(spark, sf_dir), "ation")


@query("search_capped", _SEARCH + ' SELECT *, (SELECT count(*) FROM s) > 50 AS truncated FROM s ORDER BY doc_id, line, "column" LIMIT 50')
def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_capped(_docs(spark, sf_dir), "ation", 50)


@query("line_chunks", """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '') SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 3 + 1 AS BIGINT) AS start_line, CAST(least(i * 3 + 4, len(ls)) AS BIGINT) AS end_line, array_to_string(ls[i * 3 + 1 : i * 3 + 4], chr(10)) AS chunk
  FROM d, unnest(range(0, CAST(ceil(greatest(len(ls) - 4, 0) / 3.0) AS BIGINT) + 1)) t(i)""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.line_chunks(_docs(spark, sf_dir), 4, 1)


_END = "list_min(list_filter(range({a} + 1, len(ls) + 1), lambda e: e = len(ls) OR list_sum(sz[{a} + 1 : e]) >= 600 OR list_sum(sz[{a} + 1 : e + 1]) > 600))"


@query("byte_chunks", f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents), d AS (SELECT doc_id, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i < len(r) THEN r[i] || chr(10) ELSE r[i] END), lambda x: x <> '') AS ls FROM p),
 q AS (SELECT doc_id, ls, list_transform(ls, lambda x: strlen(x)) AS sz FROM d),
 c(doc_id, ls, sz, i, a, z, o) AS (SELECT doc_id, ls, sz, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(coalesce({_END.format(a="0")}, 1) AS BIGINT), CAST(0 AS BIGINT) FROM q
  UNION ALL SELECT doc_id, ls, sz, i + 1, b, CAST({_END.format(a="b")} AS BIGINT), z FROM (SELECT *, z - least(1, (z - a) // 2) AS b FROM c WHERE z < len(ls)))
 SELECT doc_id, i AS chunk_index, a + 1 AS start_line, z AS end_line, o + 1 AS core_start_line, coalesce(array_to_string(ls[a + 1 : z], ''), '') AS chunk FROM c""")
def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.byte_chunks(_docs(spark, sf_dir), 600, 1)


@query("batches", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS BIGINT) AS batch FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.batches(_docs(spark, sf_dir).select("doc_id", "source"), 25, F.col("source"), "doc_id").select("doc_id", "batch")


QUERY_VECTOR = [((i * 7) % 11 - 5) / 5 for i in range(64)]
_VECTOR = "[" + ",".join(str(x) for x in QUERY_VECTOR) + "]::DOUBLE[]"


@query("vector_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 10).withColumn("score", F.round("score", 6))


@query("vector_topk_by_label", f"SELECT label, vec_id, round(s, 6) AS score FROM (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) AS s FROM embeddings) QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 3")
def vector_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries_ = rows.select("label").distinct().withColumn("query", F.array(*map(F.lit, QUERY_VECTOR)))
    return vectors.top_k_by(rows, queries_, 3, "label").withColumn("score", F.round("score", 6))


@query("embedding_staleness", "SELECT doc_id, CASE lang WHEN 'es' THEN 'embed' WHEN 'de' THEN 'embed' ELSE 'current' END AS outcome FROM documents UNION ALL SELECT doc_id + 1000000000000, 'sweep' FROM documents WHERE lang = 'fr'")
def embedding_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    stated = lambda d: d.select("doc_id", F.sha2("text", 256).alias("sha"), F.lit("hash-64").alias("model"))
    return vectors.stale_embeddings(stated(_before(docs)), stated(docs))


@query("semantic_search", f"SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}), 6) AS score, 'chunk ' || vec_id AS preview FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}) DESC, vec_id LIMIT 5")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("\n  chunk "), F.col("vec_id").cast("string"), F.lit(" \nrest")).alias("chunk"))
    return vectors.semantic_search(stored, QUERY_VECTOR, 5).withColumn("score", F.round("score", 6))


# -- graphs and symbols ---------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as one tree of parent pointers."""
    node = lambda t, key, kind, parent, up: table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}:"), key).alias("node_id"), (F.concat(F.lit(f"{up}:"), parent) if up else F.lit(None).cast("string")).alias("parent_id"), F.lit(kind).alias("kind"))
    return node("region", "r_regionkey", "region", None, None).unionByName(node("nation", "n_nationkey", "nation", "n_regionkey", "region")).unionByName(node("customer", "c_custkey", "customer", "c_nationkey", "nation")).unionByName(node("orders", "o_orderkey", "order", "o_custkey", "customer"))


_TREE = """WITH RECURSIVE t AS (SELECT 'region:' || r_regionkey AS node_id, NULL AS parent_id, 'region' AS kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer' FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order' FROM orders),
 a(start, ancestor, depth) AS (SELECT node_id, node_id, 0 FROM t WHERE kind = 'order' UNION ALL SELECT start, parent_id, depth + 1 FROM a JOIN t ON ancestor = node_id WHERE parent_id IS NOT NULL)"""


@query("ancestor_closure", _TREE + " SELECT start, ancestor, depth FROM a")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = materialize(_tree(spark, sf_dir), "tree")
    return graph.ancestors(tree, tree.where("kind = 'order'"))


@query("ancestor_depth", _TREE + " SELECT start, ancestor, depth FROM a WHERE ancestor LIKE 'nation:%'")
def ancestor_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = materialize(_tree(spark, sf_dir), "tree")
    return graph.nearest_ancestor(graph.ancestors(tree, tree.where("kind = 'order'")), tree, ["nation", "region"])


def _shared_lines(docs: DataFrame) -> DataFrame:
    """Edges between documents that share a line with a letter or digit, as a star around the smallest: a line's documents stay linear."""
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.col("line").rlike("[A-Za-z0-9]"))
    first = lines.groupBy(F.xxhash64("line").alias("h"), F.length("line").alias("n")).agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    hashed = lines.select("doc_id", F.xxhash64("line").alias("h"), F.length("line").alias("n"))
    return hashed.join(first, ["h", "n"]).where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()


_LINKS = """WITH RECURSIVE l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[A-Za-z0-9]')),
 f AS (SELECT line, min(doc_id) AS a FROM l GROUP BY line), e AS (SELECT DISTINCT a, doc_id AS b FROM l JOIN f USING (line) WHERE doc_id > a), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 c(node, other) AS (SELECT a, a FROM g UNION SELECT node, g.b FROM c JOIN g ON other = g.a)"""


@query("components", _LINKS + " SELECT node, min(other) AS root FROM c GROUP BY node")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(materialize(_shared_lines(_docs(spark, sf_dir)), "line-links"))


@query("affected_docs", _LINKS + ", s AS (SELECT min(a) AS seed FROM e) SELECT DISTINCT other AS node FROM c, s WHERE node = seed")
def affected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(_shared_lines(_docs(spark, sf_dir)), "line-links")
    return graph.component_of(edges, edges.agg(F.min("a").alias("node")).where("node is not null"))


@query("exists_closure", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)")
def exists_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OR of two EXISTS as a union of two semi joins."""
    customers = table(spark, sf_dir, "customer")
    returned = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    by_order = customers.join(returned, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")
    near = customers.join(table(spark, sf_dir, "nation").where("n_regionkey = 0"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("c_custkey")
    return by_order.union(near).distinct()


@query("not_exists_active", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("orphans", "SELECT doc_id, 'document' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return verify.orphans(docs, labels, "doc_id").withColumn("side", F.lit("document")).unionByName(verify.orphans(labels, docs, "doc_id").withColumn("side", F.lit("label")))


@query("snapshot_counts", "SELECT count(*) AS n_occurrences, count(DISTINCT user_id) AS n_symbols, count(*) FILTER (event_type = 'click') AS n_declaration, count(*) FILTER (event_type = 'view') AS n_reference, count(*) FILTER (event_type = 'purchase') AS n_unresolved, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS n_external FROM events")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type") == "click", "declaration").when(F.col("event_type") == "view", "reference").when(F.col("event_type") == "purchase", "unresolved").otherwise("external")
    return symbols.snapshot(table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), role.alias("role")))


_INTERVALS = "WITH i AS (SELECT doc_id, i, CAST(strlen(array_to_string(ls[1:i-1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS BIGINT) AS start, CAST(strlen(array_to_string(ls[1:i], chr(10))) AS BIGINT) AS \"end\" FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i))"


def _line_intervals(docs: DataFrame) -> DataFrame:
    """Byte ranges of lines."""
    pieces = docs.select("doc_id", F.split("text", "\n").alias("ls")).select("doc_id", F.posexplode("ls").alias("pos", "line"))
    from pyspark.sql.window import Window as W

    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    return pieces.withColumn("start", start).select("doc_id", F.col("pos").cast("long").alias("pos"), "start", (F.col("start") + F.octet_length("line")).alias("end"))


@query("overlap_anti", _INTERVALS + ', b AS (SELECT doc_id, 0 AS s, strlen(text) // 2 AS e FROM documents) SELECT i.doc_id, start, "end" FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = i.doc_id AND start < e AND "end" > s)')
def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    blockers = docs.select("doc_id", F.lit(0).cast("long").alias("start"), F.floor(F.octet_length("text") / 2).alias("end"))
    return render.without_overlap(_line_intervals(docs).select("doc_id", "start", "end"), blockers)


@query("containing_span", _INTERVALS + ', p AS (SELECT doc_id, CAST(strlen(text) // 2 AS BIGINT) AS "at" FROM documents) SELECT p.doc_id, p."at", i.start, i."end" FROM p LEFT JOIN i ON p.doc_id = i.doc_id AND p."at" >= i.start AND p."at" < i."end"')
def containing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    points = docs.select("doc_id", F.floor(F.octet_length("text") / 2).alias("at"))
    return render.containing(points, _line_intervals(docs))


@query("resolve_visible", """WITH r AS (SELECT conv_id, turn, role FROM conversations WHERE turn % 2 = 0), d AS (SELECT conv_id, turn AS dt, role, CASE WHEN turn % 4 = 1 THEN turn // 4 END AS block, CASE WHEN turn % 3 = 0 THEN 'type' ELSE 'value' END AS kind FROM conversations WHERE turn % 2 = 1),
  c AS (SELECT r.conv_id, r.turn, dt, CASE WHEN block IS NULL THEN 0 ELSE 1 END AS depth, CASE WHEN dt <= r.turn THEN dt ELSE -1 END AS before FROM r JOIN d ON r.conv_id = d.conv_id AND r.role = d.role AND (block IS NULL OR block = r.turn // 4) AND (r.turn % 8 <> 0 OR kind = 'value')),
  b AS (SELECT conv_id, turn, count(DISTINCT dt) AS n, min(dt) AS dt FROM (SELECT *, rank() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC, before DESC) AS k FROM c) WHERE k = 1 GROUP BY ALL)
  SELECT r.conv_id, r.turn AS ref_id, CASE WHEN n = 1 THEN dt END AS symbol_id, CASE WHEN n IS NULL THEN 'external' WHEN n > 1 THEN 'unresolved' ELSE 'bound' END AS role FROM r LEFT JOIN b ON r.conv_id = b.conv_id AND r.turn = b.turn""")
def resolve_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns refer to odd ones of their role: those of their block of four come before those that are global, then the latest before; every eighth turn takes values only."""
    turns = table(spark, sf_dir, "conversations")
    block = F.floor(F.col("turn") / 4)
    references = turns.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("ref_id"), F.col("role").alias("name"), F.array(block, F.col("turn")).alias("scope"), F.col("turn").alias("at"), F.when(F.col("turn") % 8 == 0, F.array(F.lit("value"))).alias("kinds"))
    scope = F.when(F.col("turn") % 4 == 1, F.array(block)).otherwise(F.array().cast("array<bigint>"))
    declared = turns.where("turn % 2 = 1").select("conv_id", F.col("turn").alias("symbol_id"), F.col("role").alias("name"), scope.alias("scope"), F.col("turn").alias("at"), F.when(F.col("turn") % 3 == 0, "type").otherwise("value").alias("kind"))
    return symbols.resolve(references, declared, "conv_id")


@query("references_agg", "SELECT p_partkey AS symbol_id, coalesce(n, 0) AS n_references, coalesce(d, '') AS documents FROM (SELECT DISTINCT p_partkey FROM part) p LEFT JOIN (SELECT l_partkey, count(*) AS n, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS d FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey")
def references_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("doc_id"), F.lit("reference").alias("role"))
    return symbols.references_of(uses, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id")).distinct())


@query("accepted_pairs", "SELECT DISTINCT p_name AS original, 'alias_' || p_partkey AS alias FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def accepted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol_id"))
    aliases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("original"), F.concat(F.lit("alias_"), F.col("p_partkey").cast("string")).alias("alias"), F.when(F.col("p_size") > 25, "accepted").otherwise("stale").alias("status"))
    return symbols.accepted_pairs(uses, aliases)


@query("min_rank_owner", "SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1")
def min_rank_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.first_owner(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey")


@query("alias_ambiguity", "SELECT lower(p_brand) AS alias_norm, list_sort(list(DISTINCT lower(p_type))) AS originals FROM (SELECT replace(p_brand, '#', 'x') AS p_brand, p_type FROM part) GROUP BY 1 HAVING count(DISTINCT lower(p_type)) > 1")
def alias_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("x")).alias("alias"), F.col("p_type").alias("original"))
    return policy.ambiguous_aliases(pairs)


@query("find_symbols", "SELECT p_partkey AS symbol_id, p_partkey AS doc_id, shown FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Alias_' || p_partkey WHEN p_partkey % 3 = 0 THEN 'Text_as_1' || p_partkey ELSE p_name END AS shown FROM part) WHERE contains(lower(shown), 'as_1') ORDER BY 3, 1 LIMIT 1000")
def find_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted aliases come before lexical replacements at a symbol's place, these before its own name; replacements elsewhere and stale aliases do not count."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.lit(4).alias("start"))
    aliases = part.select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("Alias_"), F.col("p_partkey").cast("string")).alias("alias"), F.when(F.col("p_size") > 25, "accepted").otherwise("stale").alias("status"))
    replaced = part.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 3 == 0, 4).otherwise(5).alias("original_start"), F.concat(F.lit("Text_as_1"), F.col("p_partkey").cast("string")).alias("sanitized_text"))
    return search.find_symbols(known, aliases, replaced, "AS_1")


@query("rebind", "SELECT o.l_orderkey AS doc_id, o.l_linenumber AS \"start\", CASE WHEN o.l_returnflag = 'R' THEN 'sym' || o.l_partkey ELSE NULL END AS symbol_id, CASE WHEN o.l_returnflag = 'R' THEN 'reference' ELSE 'unresolved' END AS role FROM lineitem o")
def rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    place = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.concat_ws("/", F.col("l_shipdate").cast("string"), "l_returnflag", F.col("l_partkey").cast("string")).alias("name"), F.col("l_linestatus").alias("content_hash")]
    uses = rows.select(*place, F.lit(None).cast("string").alias("symbol_id"), F.lit("unresolved").alias("role"))
    bindings = rows.where("l_returnflag = 'R'").select(*place, F.concat(F.lit("sym"), F.col("l_partkey").cast("string")).alias("symbol_id"))
    return symbols.rebind(uses, bindings).select("doc_id", "start", "symbol_id", "role")


@query("declaration_ordinals", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) - 1 AS INTEGER) AS ordinal FROM lineitem")
def declaration_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("qualified_name"), F.col("l_linenumber").alias("start"))
    return symbols.declaration_ordinals(rows).select("l_orderkey", "l_linenumber", "ordinal")


@query("python_symbols", """SELECT p_partkey AS doc_id, kind, CASE name WHEN '*' THEN 'part_' || p_partkey ELSE name END AS name, role, start_line
  FROM part, (VALUES ('FunctionDef', '*', 'declaration', 1), ('arg', 'size', 'declaration', 1), ('Name', 'size', 'reference', 2), ('Name', 'print', 'reference', 4), ('Name', '*', 'reference', 4)) t(kind, name, role, start_line)""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated Python sources, one a part, through the parser."""
    name = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    sources = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("def "), name, F.lit("(size):\n    return size + "), F.col("p_size").cast("string"), F.lit("\n\nprint("), name, F.lit("(1))\n")).alias("text"))
    return symbols.parse_python(sources).where("name is not null").select("doc_id", "kind", "name", "role", "start_line")


# -- review ---------------------------------------------------------------------------------------------------


@query("retention_keep_n", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.newest(table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("user_id"), F.col("event_id"), 3)


@query("latest_review_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest_state(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("proposal_validation", """WITH p AS (SELECT doc_id, lang, source, text, CASE WHEN source = 'src1' THEN 'absentword' WHEN source = 'src2' THEN 'the' WHEN source = 'src3' THEN 'der' WHEN source = 'src4' THEN 'two words' ELSE regexp_extract(text, '[A-Za-z0-9_]+') END AS original_text,
   CASE WHEN source = 'src5' THEN 'wa_the_r' WHEN source = 'src6' THEN '9lives' WHEN source = 'src7' THEN 'fen' ELSE 'neutralname' END AS sanitized_text, CASE WHEN source = 'src8' THEN 'comment' WHEN source = 'src9' THEN 'string' ELSE 'identifier' END AS category, CASE WHEN source = 'src10' THEN 0.5 ELSE 0.9 END AS confidence FROM documents),
  n AS (SELECT *, replace(lower(original_text), '_', '') AS o, replace(lower(sanitized_text), '_', '') AS s FROM p),
  r AS (SELECT doc_id, original_text, sanitized_text, confidence, CASE WHEN original_text = '' THEN 'original is empty' WHEN category = 'comment' THEN 'only identifiers and strings are reviewed' WHEN NOT regexp_matches(original_text, '^[A-Za-z0-9_]+$') THEN 'original cannot be matched'
    WHEN o = s THEN 'alias is the original again' WHEN NOT contains(text, original_text) THEN 'original does not occur' WHEN o = 'der' THEN 'allowlisted' WHEN o IN ('the', 'ation', 'ing') THEN 'already mapped' WHEN category = 'identifier' AND regexp_matches(sanitized_text, '^[0-9]') THEN 'alias is no identifier'
    WHEN contains(s, 'the') OR contains(s, 'ation') OR contains(s, 'ing') THEN 'a term shows in the alias' WHEN s IN ('fen', 'mork', 'usk') THEN 'alias is taken' WHEN list_contains(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: replace(lower(x), '_', '')), s) THEN 'alias occurs in the text' END AS reason FROM n)
  SELECT doc_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN original_text = 'The' THEN 'protected name' WHEN confidence < 0.8 THEN 'low confidence' ELSE 'clean' END END AS flag FROM r""")
def proposal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("language", F.lit("plaintext"))
    pick = lambda other, **cases: reduce(lambda w, kv: w.when(F.col("source") == kv[0], kv[1]), cases.items(), F.when(F.lit(False), F.lit(None))).otherwise(other)
    proposals = docs.select("doc_id", pick(F.regexp_extract("text", "[A-Za-z0-9_]+", 0), src1="absentword", src2="the", src3="der", src4="two words").alias("original_text"), pick("neutralname", src5="wa_the_r", src6="9lives", src7="fen").alias("sanitized_text"), pick("identifier", src8="comment", src9="string").alias("category"), F.when(F.col("source") == "src10", 0.5).otherwise(0.9).alias("confidence"))
    known = policy.term_table(policy.entries(spark, POLICY), SALT)
    allowed = spark.createDataFrame([("d_e_r",)], "raw string")
    protected = spark.createDataFrame([("The",)], "name string")
    return review.validate(proposals, docs, known, allowed, protected).select("doc_id", "reason", "flag")


@query("best_proposals", "SELECT s_nationkey, arg_min(s_name, (-s_acctbal, s_name)) AS sanitized_text FROM supplier GROUP BY 1")
def best_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("target").alias("original_text"), F.col("s_name").alias("sanitized_text"), F.col("s_acctbal").alias("confidence"))
    return review.best_proposals(offers, "s_nationkey").select("s_nationkey", "sanitized_text")


@query("reserve_aliases", "SELECT o_orderkey AS id FROM orders o JOIN (SELECT o_orderpriority, arg_min(o_custkey, o_orderkey) AS owner FROM orders GROUP BY 1) f ON o.o_orderpriority = f.o_orderpriority AND o.o_custkey = f.owner")
def reserve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("sanitized_text"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("original_text"))
    return review.reserve_aliases(asked).select("id")


@query("heuristic_proposals", "SELECT DISTINCT doc_id, run AS original_text, CAST(0.6 AS DOUBLE) AS confidence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS run FROM documents) WHERE run IN ('whom', 'than', 'oder')")
def heuristic_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = spark.createDataFrame([("whom",), ("than",), ("oder",)], "raw string")
    return review.heuristic_proposals(_docs(spark, sf_dir), denied).select("doc_id", "original_text", "confidence")


# -- diffs and edits ------------------------------------------------------------------------------------------


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn with the turn after it."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("old"))
    b = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    return a.join(b, ["conv_id", "turn"])


_NEXT = "(SELECT a.conv_id, a.turn, a.text AS old, b.text AS new FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query("diff_apply", f"SELECT conv_id, turn, sha256(new || chr(10)) AS digest, CAST(NULL AS VARCHAR) AS reason FROM {_NEXT}")
def diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose last line is ended, since lines that a patch adds always are."""
    ended = lambda c: F.concat(c, F.lit("\n")).alias(c)
    pairs = _turn_pairs(spark, sf_dir).select("conv_id", "turn", ended("old"), ended("new"), F.lit("turn.txt").alias("path"))
    patched = pairs.withColumn("patch", diffs.diff_texts(pairs, "old", "new", "path"))
    done = diffs.apply_patches(patched, "old", "patch")
    return done.select("conv_id", "turn", F.sha2("after", 256).alias("digest"), "reason")


@query("diff_parse", f"SELECT conv_id, turn, CASE WHEN old = new THEN 0 ELSE 1 END AS n_files, CAST(CASE WHEN old = new THEN 0 ELSE 1 END AS BIGINT) AS changed FROM {_NEXT}")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir).withColumn("path", F.lit("turn.txt"))
    parsed = diffs.parse_patches(pairs.withColumn("patch", diffs.diff_texts(pairs, "old", "new", "path")))
    edits = F.aggregate(F.flatten(F.transform(F.flatten(F.transform("files", lambda f: f["hunks"])), lambda h: h["lines"])), F.lit(0), lambda n, x: n + F.when(x["op"] == " ", 0).otherwise(1))
    return parsed.select("conv_id", "turn", F.size("files").alias("n_files"), F.when(edits > 0, 1).otherwise(0).cast("long").alias("changed"))


@query("common_changed_range", f"""WITH p AS (SELECT conv_id, turn, old, new, list_aggregate([CAST(0 AS BIGINT)] || list_filter(range(1, least(length(old), length(new)) + 1), lambda i: substr(old, 1, i) = substr(new, 1, i)), 'max') AS n FROM {_NEXT}),
  s AS (SELECT *, list_aggregate([CAST(0 AS BIGINT)] || list_filter(range(1, least(length(old), length(new)) - n + 1), lambda i: right(old, i) = right(new, i)), 'max') AS k FROM p)
  SELECT conv_id, turn, CAST(strlen(substr(old, 1, n)) AS BIGINT) AS "start", CAST(strlen(old) - strlen(right(old, k)) AS BIGINT) AS "end" FROM s""")
def common_changed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", diffs.changed_ranges(pairs, "old", "new").alias("r")).select("conv_id", "turn", "r.start", "r.end")


@query("edit_plan", "SELECT doc_id, CASE WHEN lang = 'es' THEN 'conflict' ELSE 'applied' END AS status, CASE WHEN lang <> 'es' THEN sha256('[' || substr(text, 2) || ']') END AS digest FROM documents")
def edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's first character is replaced and its end extended; Spanish texts get a third edit that overlaps."""
    return diffs.apply_edits(_docs(spark, sf_dir), _edits(_docs(spark, sf_dir))).select("doc_id", "status", F.when(F.col("status") == "applied", F.sha2("after", 256)).alias("digest"))


def _edits(docs: DataFrame) -> DataFrame:
    n, first, zero = F.octet_length("text").cast("long"), F.octet_length(F.substring("text", 1, 1)).cast("long"), F.lit(0).cast("long")
    one = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("replacement"))
    made = F.array_compact(F.array(one(zero, first, "["), one(n, n, "]"), F.when(F.col("lang") == "es", one(zero, n, "x"))))
    return docs.select("doc_id", F.explode(made).alias("e")).select("doc_id", "e.*")


@query("overlapping_edits", "SELECT doc_id FROM documents WHERE length(text) > 1000")
def overlapping_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    edits = docs.select("doc_id", F.lit(0).alias("start"), F.length("text").alias("end")).unionByName(docs.select("doc_id", F.lit(1000).alias("start"), F.lit(1000).alias("end")).where(F.col("start") >= 0))
    return diffs.overlapping_edits(edits.where(F.col("end") >= F.col("start")))


@query("translate_edits", "SELECT doc_id, sha256(text || chr(10) || 'See the tradING') AS digest, CAST(NULL AS VARCHAR) AS reason FROM documents")
def translate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with aliases in two casings is added to every render and told back."""
    made = _rendered(spark, sf_dir).select("doc_id", "text", F.col("map.rendered").alias("rendered"))
    edited = made.withColumn("edited", F.concat("rendered", F.lit("\nSee fen tradUSK")))
    return diffs.plan_modifications(edited, _terms(spark)).select("doc_id", F.sha2("planned", 256).alias("digest"), "reason")



@query("transaction_preview", "SELECT CASE WHEN lang = 'es' THEN 'conflict' ELSE 'applied' END AS status, count(*) AS n FROM documents GROUP BY 1")
def transaction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return transactions.outcome_counts(transactions.preview(docs, _edits(docs)))


@query("transaction_commit", "SELECT doc_id, sha256('[' || substr(text, 2) || ']') AS digest FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE lang = 'es'")
def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of all texts but the Spanish ones are committed."""
    docs = _docs(spark, sf_dir)
    edits = _edits(docs.where("lang <> 'es'"))
    return transactions.commit(docs, transactions.preview(docs, edits)).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("transaction_stale", "SELECT doc_id FROM documents WHERE lang IN ('de', 'es')")
def transaction_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    previewed = docs.select("doc_id", F.sha2("text", 256).alias("before_hash"))
    return transactions.sources_match(previewed, _before(docs))


@query("journal_state", "SELECT user_id AS id, arg_max(CASE event_type WHEN 'click' THEN 'applying' WHEN 'view' THEN 'applied' ELSE 'failed' END, event_id) AS status FROM events GROUP BY 1")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.journal_state(_journal(spark, sf_dir)).select("id", "status")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "applying").when(F.col("event_type") == "view", "applied").otherwise("failed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), status.alias("status"))


@query("journal_prune", "WITH s AS (SELECT user_id AS id, arg_max(event_type, event_id) = 'click' AS busy FROM events GROUP BY 1) SELECT id FROM s QUALIFY busy OR row_number() OVER (PARTITION BY busy ORDER BY id DESC) <= 20")
def journal_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.prune(_journal(spark, sf_dir), 20).select("id")


@query("recovery_actions", "SELECT doc_id AS id, doc_id, CASE lang WHEN 'de' THEN 'none' WHEN 'es' THEN 'review' ELSE 'keep' END AS action FROM documents")
def recovery_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French and English texts are as after the edit, German ones as before, Spanish ones are gone."""
    docs = _docs(spark, sf_dir)
    pending = docs.select(F.col("doc_id").alias("id"), "doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.lit("before")).alias("before"), F.col("text").alias("after"))
    return transactions.recover(pending, _before(docs))


@query("qualified_names", "SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN 'zone_' || n_regionkey ELSE r_name END || '::' || lower(n_name) AS projected FROM nation JOIN region ON n_regionkey = r_regionkey")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    names = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("::"), "n_name").alias("qualified_name"), F.lower("n_name").alias("own"))
    shown = regions.where("r_regionkey < 3").select(F.col("r_name").alias("qualified_name"), F.concat(F.lit("zone_"), F.col("r_regionkey").cast("string")).alias("projected_name"))
    return symbols.project_qualified(names, shown).select("n_nationkey", "projected")


@query("linked_aliases", "SELECT DISTINCT a.s_suppkey AS symbol_id, b.s_suppkey AS other_id, b.s_name AS alias FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE b.s_acctbal > 0")
def linked_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    links = suppliers.select(F.col("s_nationkey").alias("canonical"), F.col("s_suppkey").alias("linked"))
    return symbols.linked_aliases(links, suppliers.select(F.col("s_suppkey").alias("symbol_id"), F.col("s_name").alias("alias"), F.when(F.col("s_acctbal") > 0, "accepted").otherwise("stale").alias("status")))


@query("spread_aliases", _LINKS + ", g2 AS (SELECT node, min(other) AS root FROM c GROUP BY node), k AS (SELECT root, arg_min('alias_' || doc_id, (source, doc_id)) AS alias FROM documents JOIN g2 ON doc_id = node WHERE lang <> 'fr' GROUP BY root) SELECT node AS symbol_id, alias FROM g2 JOIN k USING (root)")
def spread_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = graph.connected_components(materialize(_shared_lines(docs), "line-links"))
    aliases = docs.select(F.col("doc_id").alias("symbol_id"), F.concat(F.lit("alias_"), F.col("doc_id").cast("string")).alias("alias"), F.when(F.col("lang") == "fr", "stale").otherwise("accepted").alias("status"), F.col("source").alias("revision"))
    return symbols.spread_aliases(found, aliases)


@query("parent_calls", "SELECT 'order:' || o_orderkey AS node_id, 'customer:' || o_custkey AS call_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def parent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.calls(_tree(spark, sf_dir), ("customer",))


@query("same_shape", "WITH s AS (SELECT p_partkey AS symbol_id, p_type AS kind, p_brand AS qualified_name, CASE WHEN p_size < 25 THEN 'c-family' ELSE 'rust' END AS family FROM part) SELECT DISTINCT s.* FROM s JOIN s w USING (kind, qualified_name, family) WHERE w.symbol_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def same_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("qualified_name"), F.when(F.col("p_size") < 12, "c").when(F.col("p_size") < 25, "cpp").otherwise("rust").alias("language"))
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("symbol_id"))
    return symbols.same_shape(part, wanted)


@query("keyed_replacements", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def keyed_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.when(F.col("l_returnflag") == "A", "semantic:").otherwise("lexical:"), F.col("l_partkey").cast("string"), F.lit(":x"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("stable_key"))
    ids = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").cast("string").alias("symbol_id"))
    return symbols.replaced_components(rows, ids).select("l_orderkey", "l_linenumber")


@query("bound_replacements", _PARTS + " SELECT doc_id, CAST(i - 1 AS BIGINT) AS id FROM s WHERE lower(original_text) = 'ing' AND ((i = 1 AND gap = '') OR regexp_matches(gap, '[^A-Za-z0-9_]$'))")
def bound_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements of ``ing`` at the beginning of a word, against occurrences made of word starts."""
    listed = materialize(render.audit(_rendered(spark, sf_dir)), "audit")
    starts = render.word_positions(_docs(spark, sf_dir)).where("is_run").where(F.lower("piece").startswith("ing"))
    return symbols.bound_replacements(listed, starts.select("doc_id", "start", (F.col("start") + 3).alias("end"), F.lit("s").alias("symbol_id"))).select("doc_id", "id")


@query("stable_keys", _PARTS + " SELECT doc_id, CAST(i - 1 AS BIGINT) AS id, sha256('doc/' || doc_id || ':identifier:' || original_start || ':' || original_text) AS stable_key FROM s")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = render.audit(_rendered(spark, sf_dir)).withColumn("category", F.lit("identifier"))
    return render.stable_keys(listed, F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).select("doc_id", "id", "stable_key")


@query("whole_word_filter", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '[A-Za-z0-9_]+'), 'than')")
def whole_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(T.contains_word(F.col("text"), "than")).select("doc_id")


@query("retire_alternatives", "SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) > 1 THEN 'stale' ELSE 'open' END AS status FROM orders")
def retire_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("created_at"))
    accepted = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("target"))
    return review.retire_alternatives(offers, accepted).select("id", "status")


@query("eligibility_funnel", "SELECT count(*) AS n_all, count(*) FILTER (p_size > 10) AS n_owned, count(*) FILTER (p_size > 10 AND length(p_name) >= 3) AS n_named, count(*) FILTER (p_size > 10 AND length(p_name) >= 3 AND p_retailprice <= 1500) AS n_unprotected, count(*) FILTER (p_size > 10 AND length(p_name) >= 3 AND p_retailprice <= 1500 AND p_brand <> 'Brand#11') AS n_eligible FROM part")
def eligibility_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, "owned").otherwise("vendor").alias("origin"), (F.col("p_retailprice") > 1500).alias("protected"), F.when(F.col("p_brand") == "Brand#11", "x").alias("alias"))
    return review.eligibility(known)


@query("snapshot_difference", "SELECT doc_id, lang, side FROM (SELECT doc_id, lang, 'right' AS side FROM documents WHERE lang IN ('es', 'de') UNION ALL SELECT doc_id, lang, 'left' FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id + 1000000000000, lang, 'left' FROM documents WHERE lang = 'fr')")
def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    shape = lambda d: d.select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return verify.different_rows(shape(_before(docs)), shape(docs)).select("doc_id", "lang", "side")


@query("duplicate_keys", "SELECT text AS text_key, count(*) AS n FROM (SELECT sha256(text) AS text FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicate_keys(_docs(spark, sf_dir).select(F.sha2("text", 256).alias("text_key")), "text_key")
