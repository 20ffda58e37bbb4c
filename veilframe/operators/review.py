"""Proposals and their review: candidates, validation, identity, decisions, latest state, retention."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.functions.matcher import PROSE
from veilframe.functions.text import is_run, normalize_term, runs, valid_identifier
from veilframe.operators.policy import term_array
from veilframe.sources.scratch import ship


def heuristic_proposals(docs: DataFrame, denied: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, original_text, confidence)``: denied words (``raw``) that stand whole in a text."""
    words = docs.select(key, F.explode(F.array_distinct(runs(F.col(text)))).alias("original_text"))
    return words.join(denied.select(F.col("raw").alias("original_text")), "original_text", "left_semi").withColumn("confidence", F.lit(0.6))


def validate(proposals: DataFrame, docs: DataFrame, terms: DataFrame, allowlist: DataFrame, protected: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``reason`` (why a proposal is rejected; the first that holds, else null) and ``flag`` (clean or why it needs review).

    ``proposals(key, original_text, sanitized_text, category, confidence)``; ``terms`` as a term table; ``allowlist(raw)``; ``protected(name)``. Where ``docs`` have no
    ``language``, their texts count as code of an unknown one.
    """
    o, s = F.col("original_text"), F.col("sanitized_text")
    language = F.col("language") if "language" in docs.columns else F.lit("text")
    p = proposals.join(docs.select(key, F.col(text).alias("_text"), language.alias("_language")), key, "left").withColumns({"_o": normalize_term(o), "_s": normalize_term(s)})
    # comments are only looked for where the original occurs at all and a comment can be; prose has none, and no other texts are sent to Python
    commented = ~F.coalesce("_language", F.lit("text")).isin(*PROSE) & F.contains("_text", o) & F.col("_text").rlike("//|/\\*|#")
    p = p.withColumn("_code", F.coalesce(without_comments(proposals, F.when(commented, F.col("_text")), F.col("_language")), "_text"))
    # policies are small tables that people write
    p = p.join(F.broadcast(allowlist.select(normalize_term(F.col("raw")).alias("_o")).distinct().withColumn("_allowed", F.lit(True))), "_o", "left")
    p = p.join(F.broadcast(terms.select(F.col("normalized").alias("_o")).distinct().withColumn("_mapped", F.lit(True))), "_o", "left")
    # protected names grow with the corpus: a plain join, whose strategy adaptive execution picks by size
    p = p.join(protected.select(F.col("name").alias("original_text")).distinct().withColumn("_protected", F.lit(True)), "original_text", "left")
    others = F.filter(term_array(terms), lambda t: t["raw"] != o)
    reason = (
        F.when(F.coalesce(o, F.lit("")) == "", "original is empty")
        .when(~F.col("category").isin("identifier", "string"), "only identifiers and strings are reviewed")
        .when(~is_run(o), "original cannot be matched")
        .when(~is_run(s), "alias cannot be matched")
        .when(F.col("_o") == F.col("_s"), "alias is the original again")
        .when(~F.coalesce(F.contains("_text", o), F.lit(False)), "original does not occur")
        .when(~F.contains("_code", o), "original stands in comments only")
        .when(F.col("_allowed"), "allowlisted")
        .when(F.col("_mapped"), "already mapped")
        .when(F.contains(s, F.lit("\n")), "alias has a line end")
        .when((F.col("category") == "identifier") & ~valid_identifier(s), "alias is no identifier")
        .when(F.exists(others, lambda t: F.contains(F.col("_s"), t["normalized"])), "a term shows in the alias")
        .when(F.exists(others, lambda t: t["alias"] == F.col("_s")), "alias is taken")
        .when(F.exists(runs(F.col("_text")), lambda r: normalize_term(r) == F.col("_s")), "alias occurs in the text")
    )
    flag = F.when(F.col("_protected"), "protected name").when(F.col("confidence") < threshold, "low confidence").otherwise("clean")
    checked = p.withColumns({"reason": reason}).withColumn("flag", F.when(F.col("reason").isNull(), flag))
    return checked.drop("_text", "_code", "_language", "_o", "_s", "_allowed", "_mapped", "_protected")


def without_comments(rows: DataFrame, text: Column, language: Column) -> Column:
    """The texts with comments blanked."""
    ship(rows.sparkSession)

    @F.arrow_udf("string")
    def blanked(bodies: pa.Array, languages: pa.Array) -> pa.Array:
        from veilframe.functions.matcher import masked_comments

        return pa.array([None if b is None else masked_comments(b, lang or "text") for b, lang in zip(bodies.to_pylist(), languages.to_pylist(), strict=True)], pa.string())

    return blanked(text, language)


def symbol_candidates(symbols: DataFrame, occurrences: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each owned symbol with a declaration: what a reviewer needs to name it.

    ``(doc_id, symbol_id, occurrence_id, name, kind, qualified_name, start_line, n_references, lines, complete, call_lines, alias)``: its declaration, how often
    it is referred to, all its lines and those of calls (joined by commas), whether no unresolved use of its name is left in its document, and
    an alias that is accepted or stale. Each part is one aggregate by symbol.
    """
    from veilframe.operators.symbols import calls

    owned = symbols.where("origin = 'owned'")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), ",")
    declared = occurrences.where("role = 'declaration'").select(F.col("symbol_id"), F.col("node_id"), "occurrence_id", "start_line")
    used = occurrences.where("symbol_id is not null").groupBy("symbol_id").agg(F.count_if(F.col("role") == "reference").alias("n_references"), listed("start_line").alias("lines"))
    open_ = occurrences.where("role = 'unresolved'").select("doc_id", "name").distinct().withColumn("_open", F.lit(True))
    called = occurrences.where("symbol_id is not null").join(calls(nodes), "node_id").groupBy("symbol_id").agg(listed("start_line").alias("call_lines"))
    known = aliases.where("status IN ('accepted', 'stale')").groupBy("symbol_id").agg(F.min("alias").alias("alias"))
    rows = owned.join(declared, ["symbol_id", "node_id"]).join(used, "symbol_id", "left").join(open_, ["doc_id", "name"], "left").join(called, "symbol_id", "left").join(known, "symbol_id", "left")
    return rows.select("doc_id", "symbol_id", "occurrence_id", "name", "kind", "qualified_name", "start_line", F.coalesce("n_references", F.lit(0)).cast("long").alias("n_references"), "lines", F.col("_open").isNull().alias("complete"), F.coalesce("call_lines", F.lit("")).alias("call_lines"), "alias")


def path_candidates(paths: DataFrame, denied: DataFrame, path: str = "path") -> DataFrame:
    """``(path, part)``: parts of paths that hold a denied term (``normalized``); denied terms are a policy, so they go along as one literal."""
    parts = paths.select(F.col(path).alias("path"), F.explode(F.array_distinct(F.split(path, "/"))).alias("part"))
    terms = F.array(*(F.lit(r["normalized"]) for r in denied.select("normalized").distinct().collect())).cast("array<string>")
    return parts.where(F.exists(terms, lambda t: F.contains(normalize_term(F.col("part")), t))).distinct()


def decide(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows to append to the review events for ``decisions(id, verdict)``: ``(id, at, status)`` of reviews whose latest state is open.

    ``reviews(id, at, status)`` is append-only. A decision on a review that is not open, or of which two decisions differ, is left out.
    """
    latest = latest_state(reviews, "id", "at", "status").where("status IN ('open', 'stale')").select("id")
    once = decisions.groupBy("id").agg(F.count_distinct("verdict").alias("n"), F.min("verdict").alias("verdict")).where("n = 1")
    next_at = reviews.groupBy("id").agg((F.max("at") + 1).alias("at"))
    return once.join(latest, "id", "left_semi").join(next_at, "id").select("id", "at", F.when(F.col("verdict") == "approve", "approved").otherwise("rejected").alias("status"))


def approve_batch(proposals: DataFrame, aliases: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``status`` (approved or a reason) to open ``proposals(id, symbol_id, original_text, sanitized_text, confidence)`` approved together.

    An alias goes to the best proposal for it (confidence, then id), if no other original has it in ``aliases(original, alias, status)`` and no word of the corpus,
    ``words(word)``, is spelt like it; a symbol takes one alias.
    """
    alias, original = normalize_term(F.col("sanitized_text")), normalize_term(F.col("original_text"))
    p = proposals.withColumns({"_a": alias, "_o": original})
    taken = aliases.where("status = 'accepted'").groupBy(normalize_term(F.col("alias")).alias("_a")).agg(F.min(normalize_term(F.col("original"))).alias("_first"), F.max(normalize_term(F.col("original"))).alias("_last"))
    natural = words.select(normalize_term(F.col("word")).alias("_a")).distinct().withColumn("_natural", F.lit(True))
    best = F.desc("confidence")
    p = p.join(taken, "_a", "left").join(natural, "_a", "left")
    foreign = F.coalesce((F.col("_first") != F.col("_o")) | (F.col("_last") != F.col("_o")), F.lit(False))
    p = p.withColumn("_blocked", foreign | F.coalesce("_natural", F.lit(False)))
    p = p.withColumn("_owner", F.first("_o").over(W.partitionBy("_a").orderBy("_blocked", best, "id")))
    p = p.withColumn("_number", F.row_number().over(W.partitionBy("symbol_id").orderBy("_blocked", F.col("_owner") != F.col("_o"), best, "id")))
    status = F.when(foreign, "alias is taken").when(F.col("_natural"), "alias is a word of the corpus").when(F.col("_owner") != F.col("_o"), "alias goes to another original").when(F.col("_number") > 1, "symbol has a better proposal").otherwise("approved")
    return p.withColumn("status", status).drop("_a", "_o", "_first", "_last", "_natural", "_blocked", "_owner", "_number")


def reconcile(reviews: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows ``(id, at, status)`` that bring open ``reviews(id, at, status, symbol_id, original_text, sanitized_text)`` up to date.

    An open one becomes stale if its symbol is gone or renamed, applied if its symbol has this very alias, and colliding if another
    original has the alias. Only rows that change something are returned.
    """
    now = reviews.groupBy("id").agg(F.max(F.struct("at", "status", "symbol_id", "original_text", "sanitized_text")).alias("s")).select("id", "s.*").where("status = 'open'")
    s = symbols.select("symbol_id", F.col("name").alias("_name"))
    own = aliases.where("status = 'accepted'").groupBy("symbol_id").agg(F.min("alias").alias("_own"))
    other = aliases.where("status = 'accepted'").groupBy(normalize_term(F.col("alias")).alias("_a")).agg(F.collect_set(normalize_term(F.col("original"))).alias("_originals"))
    j = now.withColumn("_a", normalize_term(F.col("sanitized_text"))).join(s, "symbol_id", "left").join(own, "symbol_id", "left").join(other, "_a", "left")
    foreign = F.coalesce(F.exists("_originals", lambda x: x != normalize_term(F.col("original_text"))), F.lit(False))
    status = F.when(F.col("_name").isNull() | (F.col("_name") != F.col("original_text")), "stale").when(F.col("_own") == F.col("sanitized_text"), "applied").when(foreign, "colliding")
    return j.select("id", (F.col("at") + 1).alias("at"), status.alias("status")).where("status is not null")


def best_proposals(proposals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each target and original the proposal with the highest confidence, the smaller alias on ties."""
    w = W.partitionBy(key, normalize_term(F.col("original_text"))).orderBy(F.desc("confidence"), "sanitized_text")
    return proposals.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reserve_aliases(proposals: DataFrame, order: str = "id") -> DataFrame:
    """First come, first served: an alias goes to the first original that asked for it; others drop out."""
    alias, original = normalize_term(F.col("sanitized_text")), normalize_term(F.col("original_text"))
    owner = proposals.groupBy(alias.alias("_a")).agg(F.min_by(original, order).alias("_owner"))
    return proposals.withColumn("_a", alias).join(owner, "_a").where(original == F.col("_owner")).drop("_a", "_owner")


def latest_state(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Each key's columns in its last event; ties by the largest values."""
    return events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_s")).select(key, *(f"_s.{c}" for c in columns))


def first_owner(rows: DataFrame, by: str, rank: str, owner: str) -> DataFrame:
    """``(by, owner)``: of each group the owner of smallest rank, the smaller owner on ties."""
    return rows.groupBy(by).agg(F.min(F.struct(rank, owner)).alias("_m")).select(by, F.col(f"_m.{owner}").alias(owner))


def retire_alternatives(proposals: DataFrame, accepted: DataFrame, target: str = "target") -> DataFrame:
    """Adds ``status``: stale if the target has an accepted alias or a better proposal (confidence, then time, then id), else open."""
    w = W.partitionBy(target).orderBy(F.desc("confidence"), "created_at", "id")
    taken = accepted.select(target).distinct().withColumn("_taken", F.lit(True))
    ranked = proposals.withColumn("_n", F.row_number().over(w)).join(taken, target, "left")
    return ranked.withColumn("status", F.when(F.col("_taken") | (F.col("_n") > 1), "stale").otherwise("open")).drop("_n", "_taken")


def quarantine(aliases: DataFrame) -> DataFrame:
    """Adds ``winner`` to accepted ``aliases(symbol_id, alias, original, source, confidence, revision)``: of those that share an alias across originals
    the policy's own first, then confidence, revision, id. Only proposal-sourced rows may lose.
    """
    by = W.partitionBy(normalize_term(F.col("alias")))
    order = by.orderBy((F.col("source") != "policy"), F.desc("confidence"), "revision", "symbol_id")
    several = F.size(F.collect_set(normalize_term(F.col("original"))).over(by)) > 1
    best = F.first(normalize_term(F.col("original"))).over(order)
    return aliases.withColumn("winner", ~several | (normalize_term(F.col("original")) == best) | (F.col("source") == "policy"))


def eligibility(symbols: DataFrame) -> DataFrame:
    """One row of how many symbols pass each test of the funnel, in order: all, owned, named, unprotected, without alias."""
    owned = F.col("origin") == "owned"
    named = owned & (F.length("name") >= 3)
    free = named & ~F.col("protected")
    return symbols.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(owned).alias("n_owned"), F.count_if(named).alias("n_named"), F.count_if(free).alias("n_unprotected"), F.count_if(free & F.col("alias").isNull()).alias("n_eligible"))
