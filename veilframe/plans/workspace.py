"""Queries of the workspace operators: index passes, patches, aliases, reviews. They join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.operators import aliasing, diffs, graph, indexing, patching, paths, policy, render, review, search, symbols, transactions, vectors, verify
from veilframe.plans.queries import _PARTS, _PATH, _PROJECT, SALT, _docs, _line_intervals, _page_paths, _rendered, _replaced_sql, _terms, query
from veilframe.sources.scratch import materialize, table

TWIN = 1_000_000_000_000

# -- the index pass -------------------------------------------------------------------------------------------------


def _indexed(spark: SparkSession, docs: DataFrame, mtime: int = 1) -> DataFrame:
    """The state that a first pass over ``docs(doc_id, text)`` leaves."""
    listing = docs.select("doc_id", F.lit(mtime).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("length"))
    return indexing.index_workspace(indexing.empty_state(listing), listing, lambda due: docs.join(due, "doc_id", "left_semi"), _terms(spark), SALT).state


def _second_pass(spark: SparkSession, sf_dir: str, force: bool = False) -> indexing.Pass:
    """German texts have changed, of those from src1 somebody has edited the mirror; Spanish ones are new, English ones only have a new time, and French ones had twins."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang", "source")
    older = docs.where("lang <> 'es'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    older = older.unionByName(docs.where("lang = 'fr'").withColumn("doc_id", F.col("doc_id") + TWIN))
    state = materialize(_indexed(spark, older), "first-state")
    listing = docs.select("doc_id", F.when(F.col("lang") == "fr", 1).otherwise(2).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("length"))
    mirror = state.select("doc_id", F.col("rendered").alias("present")).join(docs.select("doc_id", "lang", "source"), "doc_id")
    mirror = mirror.select("doc_id", F.when((F.col("lang") == "de") & (F.col("source") == "src1"), F.concat("present", F.lit("?"))).otherwise(F.col("present")).alias("present"))
    return indexing.index_workspace(state, listing, lambda due: docs.select("doc_id", "text").join(due, "doc_id", "left_semi"), _terms(spark), SALT, mirror, force)


_OUTCOME = "SELECT doc_id, CASE WHEN lang = 'es' THEN 'new' WHEN lang = 'fr' THEN 'unchanged' WHEN lang = 'de' THEN CASE WHEN source = 'src1' THEN '{0}' ELSE 'changed' END ELSE 'touched' END AS outcome FROM documents UNION ALL SELECT doc_id + 1000000000000, 'removed' FROM documents WHERE lang = 'fr'"


@query("workspace_pass", _OUTCOME.format("pending"))
def workspace_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_pass(spark, sf_dir).outcomes


@query("workspace_pass_forced", f"SELECT doc_id, sha256({_replaced_sql('text')}) AS rendered_hash, CASE WHEN lang = 'de' AND source = 'src1' THEN sha256({_replaced_sql('text')} || '!?') END AS stashed FROM documents")
def workspace_pass_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _second_pass(spark, sf_dir, force=True)
    return done.state.join(done.stash, "doc_id", "left").select("doc_id", "rendered_hash", F.sha2("present", 256).alias("stashed"))


@query("workspace_current", "SELECT count(*) FILTER (lang <> 'fr') AS n_read, count(*) FILTER (lang = 'fr') AS n_sweep, count(*) FILTER (lang NOT IN ('fr')) + count(*) FILTER (lang = 'fr') = 0 AS current FROM documents")
def workspace_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but French texts have another time; French ones are no longer listed."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    listing = docs.where("lang <> 'fr'").select("doc_id", F.lit(2).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("length"))
    return indexing.is_current(_indexed(spark, docs.select("doc_id", "text")), listing, _terms(spark), SALT)


@query("pending_count", "SELECT count(*) FILTER (lang = 'de') AS n_pending, count(*) FILTER (lang = 'fr') AS n_missing FROM documents")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    state = materialize(_indexed(spark, docs.select("doc_id", "text")), "state")
    mirror = state.join(docs.select("doc_id", "lang"), "doc_id").where("lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "de", F.concat("rendered", F.lit("~"))).otherwise(F.col("rendered")).alias("present"))
    return indexing.pending_count(state, mirror)


@query("reproject_paths", _PROJECT + " SELECT DISTINCT path, projected, path AS moved_from FROM q WHERE path <> projected")
def reproject_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = _page_paths(spark, sf_dir).select("path", F.col("path").alias("projected")).distinct()
    return indexing.reproject(tracked, _terms(spark))


@query("cascade_delete", "SELECT 'documents' AS name, count(*) AS n FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    left = indexing.remove_cascade({"documents": docs.select("doc_id"), "labels": labels.select("doc_id")}, docs.where("lang = 'fr'"))
    counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counted[0].unionByName(counted[1])


@query("replaced_children", "SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders were written anew: those with even keys have one line now, the others none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(orders.select("o_orderkey"), "o_orderkey")
    finished = orders.where("o_orderstatus = 'F'")
    return indexing.replace_children(lines, finished.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(0).alias("l_linenumber")), finished, "o_orderkey")


@query("workspace_checks", "SELECT 'source changed' AS \"check\", count(*) AS n FROM documents WHERE lang = 'de' UNION ALL SELECT 'mirror changed', count(*) FROM documents WHERE lang = 'es' UNION ALL SELECT 'mirror missing', count(*) FROM documents WHERE lang = 'fr' UNION ALL SELECT 'reversal', count(*) FROM documents WHERE lang = 'de' UNION ALL SELECT 'tiling', count(*) FROM documents WHERE lang = 'de' UNION ALL SELECT 'render differs', count(*) FROM documents WHERE lang = 'de' UNION ALL SELECT 'mirror untracked', 1")
def workspace_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German sources have grown since, Spanish mirrors were edited, French ones are gone, and one belongs to nothing."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    state = materialize(_indexed(spark, docs.select("doc_id", "text")), "state")
    now = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    mirror = state.join(docs.select("doc_id", "lang"), "doc_id").where("lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "es", F.concat("rendered", F.lit("~"))).otherwise(F.col("rendered")).alias("present"))
    mirror = mirror.unionByName(spark.createDataFrame([(-1, "stray")], "doc_id long, present string"))
    return verify.verify_workspace(state, now, mirror, _terms(spark)).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


# -- renders ----------------------------------------------------------------------------------------------------------


@query("span_lines", _PARTS + " SELECT doc_id, CAST(i - 1 AS BIGINT) AS id, CAST(1 + sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS original_line_start, CAST(1 + sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS sanitized_line_start FROM s")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _rendered(spark, sf_dir).select("doc_id", F.explode("map.spans").alias("s")).where("s.replacement_id is not null")
    return spans.select("doc_id", F.col("s.replacement_id").alias("id"), "s.original_line_start", "s.sanitized_line_start")


@query("stored_maps", _PARTS + " SELECT doc_id, count(*) AS n, CAST(sum(original_start) AS BIGINT) AS starts, CAST(sum(sanitized_start) AS BIGINT) AS shown FROM s GROUP BY doc_id")
def stored_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span maps as JSON and back; a document that is no map is null."""
    made = _rendered(spark, sf_dir)
    stored = made.select("doc_id", render.store_maps(made).alias("json")).unionByName(spark.createDataFrame([(-1, "{}"), (-2, "no map")], "doc_id long, json string"))
    found = stored.select("doc_id", render.load_maps(F.col("json")).alias("map")).where("map is not null")
    each = render.audit(found)
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("original_start").alias("starts"), F.sum("sanitized_start").alias("shown"))


@query("projected_ranges", f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, i, array_to_string(ls[1:i-1], chr(10)) || CASE WHEN i > 1 THEN chr(10) ELSE '' END AS before, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) t(i)) SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CAST(strlen({_replaced_sql('before')}) AS BIGINT) AS shown_start, CAST(strlen({_replaced_sql('before || line')}) AS BIGINT) AS shown_end FROM l")
def projected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _line_intervals(_docs(spark, sf_dir))
    return render.project_ranges(lines, _rendered(spark, sf_dir)).select("doc_id", "pos", "shown_start", "shown_end")


_WORD_OVER = "array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda x: CASE WHEN x = 'that' THEN 'zed' ELSE {0} END), '')"


@query("alias_overlay", f"SELECT doc_id, sha256({_WORD_OVER.format(_replaced_sql('x'))}) AS rendered_sha256, CAST(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: x = 'that')) AS BIGINT) AS n_aliases FROM documents")
def alias_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol ``that`` has an accepted alias, which comes before what the policy would replace."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    words = render.word_positions(docs).where("is_run and piece = 'that'")
    occurrences = words.select("doc_id", "start", (F.col("start") + F.octet_length("piece")).alias("end"), F.lit("s1").alias("symbol_id"))
    aliases = spark.createDataFrame([("s1", "zed", "accepted"), ("s1", "old", "stale")], "symbol_id string, alias string, status string")
    made = aliasing.merge_aliases(docs, _rendered(spark, sf_dir), occurrences, aliases)
    return made.select("doc_id", F.sha2("map.rendered", 256).alias("rendered_sha256"), F.size(F.filter("map.replacements", lambda r: r["policy_source"] == aliasing.SOURCE)).cast("long").alias("n_aliases"))


@query("placement_faults", "SELECT doc_id, CAST(0 AS BIGINT) AS \"start\", 'another text' AS fault FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, CAST(strlen(text) AS BIGINT), 'out of bounds' FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, CAST(0 AS BIGINT), 'overlap' FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, CAST(0 AS BIGINT), 'line end' FROM documents WHERE lang = 'en'")
def placement_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    n, zero, first = F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.substring("text", 1, 1)
    one = lambda a, b, new, was: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("replacement"), was.alias("original_text"))
    wide = F.octet_length(first).cast("long")
    rows = F.when(F.col("lang") == "de", F.array(one(zero, wide, "x", F.lit("?!")))).when(F.col("lang") == "es", F.array(one(n, n + 1, "x", F.lit("")))).when(F.col("lang") == "fr", F.array(one(zero, wide, "x", first), one(zero, wide, "y", first))).otherwise(F.array(one(zero, wide, "x\ny", first)))
    return render.placement_faults(docs, docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*"))


@query("output_redaction", f"SELECT doc_id, sha256(regexp_replace({_replaced_sql('text')}, '[wW][hH][oO][mM]', 'kren', 'g')) AS digest FROM documents WHERE NOT regexp_matches(text, 'W[hH][oO][mM]|w(H[oO][mM]|h(O[mM]|oM))')")
def output_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and accepted names together; a pair that is the same word, too short or protected is left out."""
    pairs = render.output_pairs(_terms(spark), [("whom", "kren"), ("a", "bb"), ("w_as", "Was"), ("ation", "other"), ("der", "dum")], frozenset({"der"}))
    docs = _docs(spark, sf_dir).where(~F.col("text").rlike("W[hH][oO][mM]|w(H[oO][mM]|h(O[mM]|oM))"))
    return docs.select("doc_id", F.sha2(render.replace_terms(docs, pairs), 256).alias("digest"))


# -- patches and transactions -------------------------------------------------------------------------------------------


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an index pass left them, by path."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    name = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    state = _indexed(spark, docs.select("doc_id", "text"))
    joined = docs.withColumn("path", name).join(state.select("doc_id", "rendered", "input_hash", "rendered_hash", "map"), "doc_id")
    return materialize(joined.withColumn("projected", F.concat(F.lit("m/"), F.col("path"))), "tracked")


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """English texts get a line with an alias, German ones are deleted, Spanish ones have drifted, beside each French one a new one is made."""
    tracked = _tracked(spark, sf_dir)
    shown = F.concat("rendered", F.lit("\n"))
    wanted = tracked.select(
        "projected",
        F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("rendered")).alias("rendered"),
        F.when(F.col("lang") == "de", "").when(F.col("lang") == "fr", "see fen new\n").otherwise(F.concat(shown, F.lit("see fen now\n"))).alias("after"),
        "lang",
    )
    path = F.when(F.col("lang") == "fr", F.concat("projected", F.lit(".new"))).otherwise(F.col("projected"))
    pairs = wanted.withColumn("name", path)
    patches = pairs.select(diffs.diff_texts(pairs, "rendered", "after", "name").alias("patch")).where("patch <> ''")
    drifted = tracked.withColumn("text", F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tracked, materialize(patching.plan_patches(patches, drifted, _terms(spark)), "plan")


@query("patch_plan", """SELECT lang || '/' || doc_id || '.txt' AS path, CASE lang WHEN 'de' THEN 'delete' ELSE 'modify' END AS op, CASE lang WHEN 'es' THEN 'conflict' ELSE 'planned' END AS status, CASE lang WHEN 'en' THEN sha256(text || chr(10) || 'see the now' || chr(10)) END AS digest
  FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'm/' || lang || '/' || doc_id || '.txt.new', 'create', 'planned', sha256('see the new' || chr(10)) FROM documents WHERE lang = 'fr'""")
def patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1].select("path", "op", "status", F.sha2("after", 256).alias("digest"))


@query("patch_commit", """SELECT lang || '/' || doc_id || '.txt' AS path, sha256(CASE lang WHEN 'en' THEN text || chr(10) || 'see the now' || chr(10) ELSE text END) AS digest FROM documents WHERE lang <> 'de'
  UNION ALL SELECT 'm/' || lang || '/' || doc_id || '.txt.new', sha256('see the new' || chr(10)) FROM documents WHERE lang = 'fr'""")
def patch_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be planned is committed; the plan with its conflicts changes nothing."""
    tracked, plan = _plan(spark, sf_dir)
    docs = tracked.select("path", "text")
    assert patching.commit_plan(docs, plan) is docs or plan.where("status = 'conflict'").isEmpty()
    return patching.commit_plan(docs, plan.where("status = 'planned'")).select("path", F.sha2("text", 256).alias("digest"))


@query("patch_recover", """SELECT lang || '/' || doc_id || '.txt' AS path, sha256(CASE lang WHEN 'es' THEN text || '?' ELSE text END) AS digest FROM documents""")
def patch_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit was interrupted: English texts are as after it, German ones as before, Spanish ones were edited since, and French ones were deleted by it."""
    tracked = _tracked(spark, sf_dir).select("path", "text", "lang")
    status = F.lit("planned")
    plan = tracked.select("path", F.col("text").alias("before"), F.when(F.col("lang") != "fr", F.concat("text", F.lit("!"))).alias("after"), status.alias("status"))
    journal = patching.journal_entry(plan, "e1", 1)
    now = tracked.where("lang <> 'fr'").select("path", F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).when(F.col("lang") == "es", F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    return patching.recover(now, journal, 2)[0].select("path", F.sha2("text", 256).alias("digest"))


@query("recovery_verdicts", "SELECT 'e-' || lang AS id, CASE lang WHEN 'en' THEN 'applied' WHEN 'es' THEN 'failed' ELSE 'rolled-back' END AS status FROM documents GROUP BY lang")
def recovery_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, an entry a language."""
    docs = _docs(spark, sf_dir).select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text", "lang")
    journal = docs.select(F.concat(F.lit("e-"), "lang").alias("id"), F.lit(1).cast("long").alias("at"), F.lit("applying").alias("status"), "path", F.col("text").alias("before"), F.when(F.col("lang") != "fr", F.concat("text", F.lit("!"))).alias("after"))
    # of the French entry one document is not yet gone, so it is not applied
    first = docs.where("lang = 'fr'").agg(F.min("path").alias("path"))
    now = docs.where("lang <> 'fr'").select("path", F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).when(F.col("lang") == "es", F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    now = now.unionByName(docs.join(first, "path", "left_semi").select("path", "text"))
    return patching.recover(now, journal, 2)[1].select("id", "status")


@query("document_rename", "SELECT 'en/' || doc_id || '.txt' AS path, CAST(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: x = 'that')) AS BIGINT) AS \"count\" FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en')")
def document_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where("lang = 'en'").select(F.concat(F.lit("en/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id")
    first = docs.agg(F.min_by("path", "doc_id")).first()[0] or ""
    return patching.rename_word(docs, first, "that", "zed").select("path", "count")


@query("transaction_once", "SELECT doc_id, sha256('[' || substr(text, 2) || ']') AS digest, CAST(8 AS BIGINT) AS revision, 'committed' AS status FROM documents")
def transaction_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit moves the control row by one; the same commit again moves nothing."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    n, first, zero = F.octet_length("text").cast("long"), F.octet_length(F.substring("text", 1, 1)).cast("long"), F.lit(0).cast("long")
    one = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("replacement"))
    edits = docs.select("doc_id", F.explode(F.array(one(zero, first, "["), one(n, n, "]"))).alias("e")).select("doc_id", "e.*")
    control = spark.createDataFrame([(7,)], "revision long")
    ledger = spark.createDataFrame([], "id string, status string, base_revision long, committed_revision long")
    previewed = materialize(transactions.preview(docs, edits), "preview")
    state = transactions.commit_transaction(docs, control, ledger, previewed, "t1", 7)
    state = transactions.commit_transaction(*state, previewed, "t1", 7)
    after, moved, entries = state
    revision, status = moved.first()["revision"], entries.first()["status"]
    return after.select("doc_id", F.sha2("text", 256).alias("digest"), F.lit(revision).cast("long").alias("revision"), F.lit(status).alias("status"))


# -- symbols ----------------------------------------------------------------------------------------------------------


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of forty levels: each customer's parent is the one with the key before, but for every fortieth."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    top = F.col("node_id") % 40 == 0
    return keys.select("node_id", F.when(~top, F.col("node_id") - 1).alias("parent_id"), F.when(top, "preproc_if").when(F.col("node_id") % 7 == 0, "preproc_else").otherwise("block").alias("kind"))


_CHAIN = "WITH c AS (SELECT c_custkey AS start, c_custkey // 40 * 40 AS top FROM customer)"


@query("deep_ancestors", _CHAIN + " SELECT start, CAST(a AS BIGINT) AS ancestor, CAST(start - a AS INTEGER) AS depth FROM c, unnest(range(top, start + 1)) t(a)")
def deep_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = materialize(_chain(spark, sf_dir), "chain")
    return graph.ancestors(chain, chain)


@query("ancestor_prefix", _CHAIN + " SELECT start, CAST(max(a) AS BIGINT) AS ancestor, CAST(start - max(a) AS INTEGER) AS depth FROM c, unnest(range(top, start + 1)) t(a) WHERE a = top OR a % 7 = 0 GROUP BY start")
def ancestor_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = materialize(_chain(spark, sf_dir), "chain")
    return graph.nearest_ancestor(graph.ancestors(chain, chain), chain, [], ["preproc_"])


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") > 10, "owned").otherwise("vendor").alias("origin"), "p_size", "p_brand")


@query("alias_candidates", """SELECT p_partkey AS symbol_id, CASE WHEN p_size <= 10 THEN 'the symbol is not owned' WHEN p_partkey % 5 = 0 THEN 'the alias is no identifier' WHEN p_partkey % 5 = 1 THEN 'the alias is the name' WHEN p_partkey % 5 = 2 THEN 'a lexical replacement has the alias'
  WHEN p_partkey % 5 = 3 THEN 'another original has the alias' WHEN p_partkey % 10 = 4 THEN 'a symbol is named like the alias' END AS reason FROM part""")
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _symbols(spark, sf_dir)
    k = F.col("symbol_id")
    alias = F.when(k % 5 == 0, F.concat(F.lit("9x"), k.cast("string"))).when(k % 5 == 1, F.upper("name")).when(k % 5 == 2, "fen").when(k % 5 == 3, "taken_one").when(k % 10 == 4, "Reserved_Name").otherwise(F.concat(F.lit("zed"), k.cast("string")))
    candidates = known.select("symbol_id", alias.alias("alias"))
    more = spark.createDataFrame([(-1, "elsewhere", "vendor"), (-2, "reserved_name", "vendor")], "symbol_id long, name string, origin string")
    aliases = spark.createDataFrame([(-1, "elsewhere", "Taken_One", "accepted")], "symbol_id long, original string, alias string, status string")
    links = spark.createDataFrame([], "canonical long, linked long")
    lexical = spark.createDataFrame([("the", "fen")], "original_text string, sanitized_text string")
    return aliasing.validate_aliases(candidates, known.select("symbol_id", "name", "origin").unionByName(more), aliases, links, lexical).select("symbol_id", "reason")


@query("accepted_batch", "WITH b AS (SELECT p_brand, min(p_partkey) AS best FROM part WHERE p_size > 10 GROUP BY 1) SELECT best AS symbol_id, replace(lower(p_brand), '#', '_') AS alias FROM b")
def accepted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a brand ask for the brand's name as alias; the one with the smallest key gets it."""
    known = _symbols(spark, sf_dir)
    candidates = known.select("symbol_id", F.regexp_replace(F.lower("p_brand"), "#", "_").alias("alias"), F.lit("review").alias("source"), F.lit(0.9).alias("confidence"))
    empty = spark.createDataFrame([], "symbol_id long, original string, alias string, status string, source string, confidence double, revision long")
    after, _ = aliasing.accept_aliases(candidates, known.select("symbol_id", "name", "origin"), empty, spark.createDataFrame([], "canonical long, linked long"), spark.createDataFrame([], "original_text string, sanitized_text string"), 3)
    return after.where("status = 'accepted' and revision = 3").select("symbol_id", "alias")


@query("admitted_locations", """WITH l AS (SELECT DISTINCT l_partkey, l_orderkey, o_orderstatus, CASE WHEN o_orderstatus IS NULL THEN 'the document is not tracked' WHEN o_orderstatus = 'P' THEN 'the document has changed' END AS own FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
  SELECT l_orderkey AS doc_id, l_partkey AS "start", CASE WHEN own IS NOT NULL THEN own WHEN count(own) OVER (PARTITION BY l_partkey) > 0 THEN 'another place of the symbol was refused' END AS reason FROM l""")
def admitted_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), table(spark, sf_dir, "orders")
    place = [F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name")]
    locations = lines.select(F.col("l_partkey").alias("symbol_id"), *place, F.lit("h").alias("content_hash"))
    documents = orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("h").alias("content_hash"))
    occurrences = lines.select(*place, F.lit(None).cast("long").alias("symbol_id"))
    none = locations.limit(0).select("symbol_id", "doc_id", "start", "end", "name", "content_hash")
    return aliasing.admit_locations(locations, documents, occurrences, none)[1].select("doc_id", "start", "reason")


@query("reapplied_bindings", """WITH b AS (SELECT DISTINCT l_partkey, l_orderkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT DISTINCT l_partkey FROM b WHERE o_orderstatus = 'P')
  SELECT CASE WHEN l_partkey IN (SELECT l_partkey FROM s) THEN 'unresolved' ELSE 'reference' END AS role, count(*) AS n, count(DISTINCT CASE WHEN l_partkey IN (SELECT l_partkey FROM s) THEN l_partkey END) AS n_stale FROM b GROUP BY 1""")
def reapplied_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders' documents have changed, so all bindings of the parts in them are stale."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey").distinct()
    place = [F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_partkey").alias("symbol_id")]
    bindings = lines.select(*place, F.lit("h").alias("content_hash"))
    occurrences = lines.select(*place, F.lit("reference").alias("role"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("h").alias("content_hash"))
    aliases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.lit("a").alias("alias"), F.lit("accepted").alias("status"))
    done = aliasing.reapply_bindings(occurrences, bindings, spark.createDataFrame([], "canonical long, linked long"), documents, aliases, aliases.withColumn("status", F.lit("open")))
    stale = done["aliases"].where("status = 'stale'").select(F.col("symbol_id").alias("_s"))
    counted = done["occurrences"].join(bindings.select("doc_id", "start", F.col("symbol_id").alias("was")), ["doc_id", "start"]).join(stale, F.col("was") == F.col("_s"), "left")
    return counted.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_s").alias("n_stale"))


@query("complete_symbols", _CHAIN + " SELECT start AS symbol_id, NOT EXISTS (SELECT 1 FROM customer u WHERE u.c_mktsegment = 'BUILDING' AND u.c_custkey >= start AND u.c_custkey // 40 = start // 40 AND u.c_nationkey = o.c_nationkey) AS complete FROM c JOIN customer o ON c_custkey = start")
def complete_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a symbol named by its nation, whose scope is its node; customers of one segment are unresolved uses."""
    chain, customers = materialize(_chain(spark, sf_dir), "chain"), table(spark, sf_dir, "customer")
    known = customers.select(F.col("c_custkey").alias("symbol_id"), F.lit(1).alias("doc_id"), F.col("c_nationkey").alias("name"))
    uses = customers.select(F.lit(1).alias("doc_id"), F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "unresolved").otherwise("external").alias("role"))
    none = spark.createDataFrame([], "canonical long, linked long")
    return aliasing.complete_symbols(known, uses, chain, known.select("symbol_id", F.col("symbol_id").alias("node_id")), known.limit(0).select("symbol_id"), none, known.limit(0).select("symbol_id"))


@query("unit_closures", """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), r(start, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT start, b FROM r JOIN e ON a = node)
  SELECT s_suppkey AS symbol_id, NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = seg AND c_nationkey NOT IN (SELECT node FROM r WHERE start = s_nationkey)) AS "local", (SELECT count(*) FROM r WHERE start = s_nationkey) AS n_documents
  FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'NOBODY' END AS seg FROM supplier)""")
def unit_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations include one another in circles; suppliers are symbols that customers use by the name of their segment."""
    nations = table(spark, sf_dir, "nation")
    includes = nations.select(F.col("n_nationkey").alias("doc_id"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("included"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_nationkey").alias("doc_id"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("NOBODY").alias("name"))
    uses = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("doc_id"))
    return aliasing.unit_closures(known, includes, uses)


@query("imported_aliases", "SELECT p_partkey AS symbol_id, 'part_' || p_partkey AS original, 'alias_' || p_partkey AS alias FROM part WHERE p_size > 10 AND p_partkey IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)")
def imported_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span maps show each part's alias where it is used; seventh lines that were returned show another, which makes it two."""
    lines = table(spark, sf_dir, "lineitem")
    at = [F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("original_start"), (F.col("l_partkey") + 1).alias("original_end")]
    name = F.concat(F.lit("alias_"), F.col("l_partkey").cast("string"))
    shown = lines.select(*at, name.alias("sanitized_text")).unionByName(lines.where("l_returnflag = 'R' and l_linenumber = 7").select(*at, F.lit("other").alias("sanitized_text")))
    uses = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 1).alias("end"), F.col("l_partkey").alias("symbol_id")).distinct()
    return aliasing.import_aliases(shown, uses, _symbols(spark, sf_dir)).select("symbol_id", "original", "alias")


@query("symbol_candidates", """SELECT o_orderkey AS symbol_id, coalesce(n, 0) AS n_references, 'order_' || o_orderkey AS name, coalesce(lines, '1') AS lines, o_orderstatus <> 'P' AS complete, coalesce(calls, '') AS call_lines FROM orders LEFT JOIN
  (SELECT l_orderkey, count(*) AS n, '1,' || string_agg(CAST(l_linenumber + 1 AS VARCHAR), ',' ORDER BY l_linenumber) AS lines, string_agg(CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber + 1 AS VARCHAR) END, ',' ORDER BY l_linenumber) AS calls FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0""")
def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are symbols of a document each, their lines are references below calls if they were returned; pending ones have an unresolved use left."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    key, name = F.col("o_orderkey"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    known = orders.select(key.alias("symbol_id"), key.alias("doc_id"), F.concat(F.lit("d"), key.cast("string")).alias("node_id"), name.alias("name"), F.lit("variable").alias("kind"), name.alias("qualified_name"), F.when(key % 3 == 0, "vendor").otherwise("owned").alias("origin"))
    declared = known.select("doc_id", "symbol_id", "node_id", F.concat(F.lit("o"), "node_id").alias("occurrence_id"), "name", F.lit("declaration").alias("role"), F.lit(1).alias("start_line"))
    node = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    used = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("symbol_id"), node.alias("node_id"), node.alias("occurrence_id"), F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("name"), F.lit("reference").alias("role"), (F.col("l_linenumber") + 1).alias("start_line"))
    open_ = orders.where("o_orderstatus = 'P'").select(key.alias("doc_id"), F.lit(None).cast("long").alias("symbol_id"), F.lit("x").alias("node_id"), F.lit("x").alias("occurrence_id"), name.alias("name"), F.lit("unresolved").alias("role"), F.lit(99).alias("start_line"))
    nodes = lines.select(node.alias("node_id"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("call"), node)).alias("parent_id"), F.lit("identifier").alias("kind"))
    nodes = nodes.unionByName(lines.where("l_returnflag = 'R'").select(F.concat(F.lit("call"), node).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("call_expression").alias("kind")))
    aliases = spark.createDataFrame([], "symbol_id long, alias string, status string")
    return review.symbol_candidates(known, declared.unionByName(used).unionByName(open_), aliases, nodes).select("symbol_id", "n_references", "name", "lines", "complete", "call_lines")


@query("placed_symbols", "SELECT o_orderkey AS symbol_id, l_linenumber AS \"start\", o_orderstatus AS content_hash FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")
def placed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    known = orders.select(F.col("o_orderkey").alias("symbol_id"), F.col("o_orderkey").alias("doc_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(":1")).alias("node_id"))
    nodes = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("node_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    return aliasing.placed_symbols(known, nodes, orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("content_hash"))).select("symbol_id", "start", "content_hash")


@query("declared_in", "SELECT p_brand AS name, min(p_partkey) AS doc_id FROM part GROUP BY 1")
def declared_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("start"), F.lit("declaration").alias("role"))
    return aliasing.declared_in(places).select("name", "doc_id")


@query("preferred_row", "SELECT s_nationkey, arg_min(s_suppkey, (CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1")
def preferred_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliasing.preferred(table(spark, sf_dir, "supplier"), "s_nationkey", F.col("s_acctbal") > 0, "s_suppkey").select("s_nationkey", "s_suppkey")


@query("scoped_paths", f"SELECT page_id FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE path = 'example.com' OR starts_with(path, 'example.com/')")
def scoped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliasing.scoped(_page_paths(spark, sf_dir), F.col("path"), "example.com/").select("page_id")


@query("ordered_occurrences", "SELECT l_partkey AS symbol_id, l_orderkey AS doc_id, l_linenumber AS \"start\", row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) ORDER BY 1, 2, 3")
def ordered_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"))
    found = symbols.occurrences_of(uses, table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("symbol_id")))
    return found.withColumn("place", F.row_number().over(W.orderBy("symbol_id", "doc_id", "start")).cast("long"))


@query("point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 32, 65)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup(table(spark, sf_dir, "orders"), [1, 7, 32, 65], "o_orderkey").select("o_orderkey", "o_custkey")


@query("read_documents", _PROJECT + ", t AS (SELECT DISTINCT path, projected FROM q) SELECT projected AS asked, path, 'text of ' || path AS rendered FROM t UNION ALL SELECT 'no/such/file', NULL, NULL")
def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = paths.project_paths(_page_paths(spark, sf_dir).select("path").distinct(), _terms(spark))
    tracked = projected.select("path", F.concat(F.lit("text of "), "path").alias("rendered"))
    asked = projected.select(F.col("projected").alias("asked")).unionByName(spark.createDataFrame([("no/such/file",)], "asked string"))
    return search.read_documents(tracked, paths.path_map(projected), asked)


@query("new_paths", _PROJECT + f", r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM q) SELECT {_replaced_sql('dir')} || '/new/leaf' AS asked, dir || '/new/leaf' AS real FROM r UNION ALL SELECT {_replaced_sql('dir')} || '/other/leaf', NULL FROM r")
def new_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New parts must be neutral: ``other`` holds a term."""
    projected = paths.project_paths(_page_paths(spark, sf_dir), _terms(spark))
    folder = F.regexp_replace("projected", "/[^/]*$", "")
    asked = projected.select(F.explode(F.array(F.concat(folder, F.lit("/new/leaf")), F.concat(folder, F.lit("/other/leaf")))).alias("asked"))
    return paths.resolve_new(asked, paths.path_map(projected), terms=_terms(spark))


# -- review and vectors -------------------------------------------------------------------------------------------------


@query("approved_batch", """WITH p AS (SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders), f AS (SELECT *, o_orderpriority = '5-LOW' AS blocked FROM p), w AS (SELECT *, first_value(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, id) AS owner FROM f),
  n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY blocked, owner <> o_custkey, o_totalprice DESC, id) AS k FROM w)
  SELECT id, CASE WHEN blocked THEN 'alias is taken' WHEN owner <> o_custkey THEN 'alias goes to another original' WHEN k > 1 THEN 'symbol has a better proposal' ELSE 'approved' END AS status FROM n""")
def approved_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for the names of priorities; one of these is taken already."""
    plain = F.translate("o_orderpriority", " -", "__")
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("original_text"), plain.alias("sanitized_text"), F.col("o_totalprice").alias("confidence"))
    aliases = spark.createDataFrame([("elsewhere", "5_LOW", "accepted")], "original string, alias string, status string")
    return review.approve_batch(asked, aliases, spark.createDataFrame([("nobody",)], "word string")).select("id", "status")


@query("decisions", "WITH s AS (SELECT user_id AS id, arg_max(event_type, event_id) AS last, max(event_id) AS a FROM events GROUP BY 1) SELECT id, a + 1 AS \"at\", CASE WHEN id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM s WHERE last IN ('click', 'view') AND id % 5 <> 0")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are reviews, open after a click and stale after a view. Those with a key divisible by 5 get two different verdicts."""
    events = table(spark, sf_dir, "events")
    reviews = events.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "view", "stale").otherwise("done").alias("status"))
    users = events.select(F.col("user_id").alias("id")).distinct()
    first = users.select("id", F.when(F.col("id") % 2 == 0, "approve").otherwise("reject").alias("verdict"))
    second = users.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "reject").otherwise("approve").alias("verdict"))
    return review.decide(reviews, first.unionByName(second))


@query("reconciled_reviews", "SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL OR o_orderpriority = '1-URGENT' THEN 'stale' WHEN o_orderkey % 2 = 0 THEN 'applied' ELSE 'colliding' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def reconciled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are open reviews of their customers' names. Customers in debt are gone, those of urgent ones are named otherwise; the others have the alias of even orders, and something else has that of odd ones."""
    orders = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "former").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    alias = F.when(even, F.concat(F.lit("a"), F.col("o_custkey").cast("string"))).otherwise("shared")
    reviews = orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("at"), F.lit("open").alias("status"), F.col("o_custkey").alias("symbol_id"), name.alias("original_text"), alias.alias("sanitized_text"))
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    known = customers.select(F.col("c_custkey").alias("symbol_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    aliases = known.select("symbol_id", F.col("name").alias("original"), F.regexp_replace("name", "^c", "a").alias("alias"), F.lit("accepted").alias("status"))
    other = spark.createDataFrame([(-1, "elsewhere", "shared", "accepted")], "symbol_id long, original string, alias string, status string")
    return review.reconcile(reviews, known, aliases.unionByName(other)).select("id", "status")


@query("path_candidates", f"SELECT DISTINCT path, part FROM (SELECT {_PATH} AS path, unnest(string_split({_PATH}, '/')) AS part FROM pages) WHERE contains(replace(replace(lower(part), '_', ''), '-', ''), 'exam')")
def path_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.path_candidates(_page_paths(spark, sf_dir), spark.createDataFrame([("exam",)], "normalized string"))


@query("setting_violations", "SELECT * FROM (VALUES ('out of range', 'confidence_threshold', '1.5'), ('unknown setting', 'colour', '1.0'), ('no number', 'chunk_lines', NULL)) t(\"check\", raw, other)")
def setting_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    del sf_dir
    return policy.setting_violations(spark.createDataFrame([("confidence_threshold", 1.5), ("max_file_bytes", 10.0), ("colour", 1.0), ("chunk_lines", None), ("chunk_overlap", 0.0)], "name string, value double"))


@query("search_gate", "SELECT count(*) FILTER (lang = 'es') AS n_missing, count(*) FILTER (lang = 'de') AS n_stale, count(*) FILTER (lang = 'fr') AS n_other_model, count(*) = 0 AS usable FROM documents")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    state = docs.where("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("sha")).alias("sha"), F.when(F.col("lang") == "fr", "m1").otherwise("m2").alias("model"))
    return vectors.search_gate(state, docs, "m2")


@query("committed_embeddings", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'old' ELSE 'new' END AS vector FROM documents WHERE lang IN ('en', 'es')")
def committed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts had vectors, Spanish ones were embedded now, German ones too, but they have changed meanwhile; French ones are gone."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    state = docs.where("lang IN ('en', 'fr')").select("doc_id", "sha", F.lit("m").alias("model"))
    fresh = docs.where("lang IN ('es', 'de')").select("doc_id", F.when(F.col("lang") == "de", "older").otherwise(F.col("sha")).alias("sha"), F.lit("m").alias("model"), F.lit("new").alias("vector"))
    kept, found = vectors.commit_embeddings(state, state.select("doc_id", F.lit("old").alias("vector")), fresh, docs.where("lang <> 'fr'"))
    return found.join(kept.select("doc_id"), "doc_id")


@query("hot_batches", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 50 AS BIGINT) AS batch FROM events")
def hot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are one group."""
    from veilframe.operators.chunks import batches

    return batches(table(spark, sf_dir, "events").select("event_id"), 50, F.lit("all"), "event_id").select("event_id", "batch")
