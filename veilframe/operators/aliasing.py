"""Upkeep of symbol aliases: overlay on renders, validation, acceptance, stored bindings, completeness.

Tables: ``symbols(symbol_id, doc_id, node_id, name, kind, qualified_name, origin, locally_bound)``, ``occurrences(doc_id, start, end, node_id, name, symbol_id, role)``,
``aliases(symbol_id, original, alias, status, source, confidence, revision)``, ``bindings(symbol_id, doc_id, start, end, name, content_hash)``,
``links(canonical, linked)``, ``documents(doc_id, content_hash)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.functions.text import is_run, normalize_term, valid_identifier
from veilframe.operators import graph, render, symbols
from veilframe.operators.transactions import require_revision
from veilframe.sources.scratch import materialize

SOURCE = "semantic-alias"


def overlay(lexical: DataFrame, occurrences: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replacements ``(doc_id, start, end, replacement, policy_source)``: accepted aliases where their symbols occur, and lexical ones that overlap none of these.

    ``lexical`` has the same columns. Occurrences of one place with several aliases take the smallest.
    """
    accepted = aliases.where("status = 'accepted'").select("symbol_id", "alias")
    placed = occurrences.where("symbol_id is not null").join(accepted, "symbol_id")
    own = placed.groupBy("doc_id", "start", "end").agg(F.min("alias").alias("replacement")).withColumn("policy_source", F.lit(SOURCE))
    own = materialize(own, "overlay")
    return own.unionByName(render.without_overlap(lexical.select(own.columns), own))


def merge_aliases(docs: DataFrame, rendered: DataFrame, occurrences: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """Documents rendered again with accepted aliases over their lexical replacements; ``rendered`` has the lexical ``map``."""
    lexical = render.audit(rendered).select("doc_id", F.col("original_start").alias("start"), F.col("original_end").alias("end"), F.col("sanitized_text").alias("replacement"), "policy_source")
    return render.render_placed(docs, overlay(lexical, occurrences, aliases), text)


def equivalents(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(symbol_id, other_id)``: each wanted ``symbol_id`` with all that links join it to, itself included."""
    edges = links.select(F.least("canonical", "linked").alias("a"), F.greatest("canonical", "linked").alias("b")).where("a < b").distinct()
    roots = materialize(graph.connected_components(materialize(edges, "alias-links")), "alias-components")
    own = wanted.select("symbol_id").distinct().join(roots.select(F.col("node").alias("symbol_id"), "root"), "symbol_id", "left")
    linked = own.where("root is not null").join(roots, "root").select("symbol_id", F.col("node").alias("other_id"))
    return linked.unionByName(own.where("root is null").select("symbol_id", F.col("symbol_id").alias("other_id")))


def validate_aliases(candidates: DataFrame, symbol_table: DataFrame, aliases: DataFrame, links: DataFrame, lexical: DataFrame) -> DataFrame:
    """Adds ``reason`` to ``candidates(symbol_id, alias)``: the first that holds, null if the alias may be accepted.

    Aliases must be injective by original spelling over the workspace: no other original may have one, neither by a symbol alias nor by a lexical replacement
    (``lexical(original_text, sanitized_text)``), and no symbol may be named like it, but for those that are equivalent to the candidate's.
    """
    a = normalize_term(F.col("alias"))
    c = candidates.withColumn("_a", a).join(symbol_table.select("symbol_id", F.col("name").alias("_name"), F.col("origin").alias("_origin")), "symbol_id", "left")
    alike = materialize(equivalents(links, candidates), "alias-equivalents")
    named = alike.join(symbol_table.select(F.col("symbol_id").alias("other_id"), F.col("name").alias("_n")), "other_id").groupBy("symbol_id").agg(F.collect_set(normalize_term(F.col("_n"))).alias("_originals"), F.collect_set("other_id").alias("_alike"))
    other = alike.join(aliases.where("status = 'accepted'").select(F.col("symbol_id").alias("other_id"), F.col("alias").alias("_theirs")), "other_id").groupBy("symbol_id").agg(F.collect_set("_theirs").alias("_given"))
    used = lexical.groupBy(normalize_term(F.col("sanitized_text")).alias("_a")).agg(F.collect_set(normalize_term(F.col("original_text"))).alias("_lexical"))
    known = aliases.where("status IN ('accepted', 'stale')").groupBy(normalize_term(F.col("alias")).alias("_a")).agg(F.collect_set(F.struct("symbol_id", normalize_term(F.col("original")).alias("original"))).alias("_known"))
    natural = symbol_table.groupBy(normalize_term(F.col("name")).alias("_a")).agg(F.collect_set("symbol_id").alias("_natural"))
    j = c.join(named, "symbol_id", "left").join(other, "symbol_id", "left").join(used, "_a", "left").join(known, "_a", "left").join(natural, "_a", "left")
    mine = lambda x: F.array_contains("_originals", x)
    reason = (
        F.when(F.col("_name").isNull(), "there is no such symbol")
        .when(F.col("_origin") != "owned", "the symbol is not owned")
        .when(~is_run(F.col("alias")) | ~valid_identifier(F.col("alias")), "the alias is no identifier")
        .when(F.col("_a") == normalize_term(F.col("_name")), "the alias is the name")
        .when(F.exists("_given", lambda x: x != F.col("alias")), "an equivalent symbol has another alias")
        .when(F.exists("_lexical", lambda x: ~mine(x)), "a lexical replacement has the alias")
        .when(F.exists("_known", lambda x: ~F.array_contains("_alike", x["symbol_id"]) & ~mine(x["original"])), "another original has the alias")
        .when(F.exists("_natural", lambda x: ~F.array_contains("_alike", x)), "a symbol is named like the alias")
    )
    return j.select(*candidates.columns, reason.alias("reason"))


def accept_aliases(candidates: DataFrame, symbol_table: DataFrame, aliases: DataFrame, links: DataFrame, lexical: DataFrame, revision: int) -> tuple[DataFrame, DataFrame]:
    """``(aliases after, decisions)`` for a batch ``candidates(symbol_id, alias, source, confidence)``.

    Valid ones are accepted for their symbol and all equivalent ones, in place of what these had. Of several in the batch that share an alias across originals, or a
    symbol, the best stays (confidence, then smaller id). A rejected one changes nothing.
    """
    judged = materialize(validate_aliases(candidates, symbol_table, aliases, links, lexical), "alias-candidates")
    alike = equivalents(links, judged.where("reason is null"))
    originals = symbol_table.select(F.col("symbol_id").alias("other_id"), F.col("name").alias("original"))
    own = symbol_table.select("symbol_id", normalize_term(F.col("name")).alias("_own"))
    spread = judged.where("reason is null").join(own, "symbol_id").join(alike, "symbol_id").join(originals, "other_id")
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("symbol_id").alias("s"))
    owner = F.first("_own").over(W.partitionBy(normalize_term(F.col("alias"))).orderBy(rank))
    ranked = spread.withColumns({"_owner": owner, "_n": F.row_number().over(W.partitionBy("other_id").orderBy(rank))})
    fine = (F.col("_owner") == F.col("_own")) & (F.col("_n") == 1)
    kept = materialize(ranked.where(fine).select(F.col("other_id").alias("symbol_id"), "original", "alias", F.lit("accepted").alias("status"), "source", "confidence", F.lit(revision).cast("long").alias("revision"), F.col("symbol_id").alias("_by")), "alias-accepted")
    after = aliases.join(kept.select("symbol_id"), "symbol_id", "left_anti").unionByName(kept.select(aliases.columns))
    won = kept.select(F.col("_by").alias("symbol_id"), "alias").distinct().withColumn("_won", F.lit(True))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_won").isNull(), "another candidate of the batch is better")
    return after, judged.join(won, ["symbol_id", "alias"], "left").withColumn("reason", reason).drop("_won")


def import_aliases(replacements: DataFrame, occurrences: DataFrame, symbol_table: DataFrame, revision: int = 0) -> DataFrame:
    """Aliases that older span maps imply: replacements that stand exactly where a bound occurrence does, by symbol; a symbol with several gets none."""
    here = occurrences.where("symbol_id is not null").select("doc_id", F.col("start").alias("original_start"), F.col("end").alias("original_end"), "symbol_id")
    found = replacements.join(here, ["doc_id", "original_start", "original_end"]).groupBy("symbol_id").agg(F.count_distinct("sanitized_text").alias("n"), F.min("sanitized_text").alias("alias")).where("n = 1")
    named = found.join(symbol_table.where("origin = 'owned'").select("symbol_id", F.col("name").alias("original")), "symbol_id")
    return named.select("symbol_id", "original", "alias", F.lit("accepted").alias("status"), F.lit("import").alias("source"), F.lit(1.0).alias("confidence"), F.lit(revision).cast("long").alias("revision"))


def reapply_bindings(occurrences: DataFrame, bindings: DataFrame, links: DataFrame, documents: DataFrame, aliases: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """Stored bindings after documents were parsed anew, in seven steps.

    1. Groups (symbols, or what links join) of which a binding's document is gone or has other content are stale, whole.
    2. Their bindings go, 3. and their links. 4. The bindings that are left bind occurrences of the same place, name and content. 5. Occurrences whose symbol was
    bound by a stale group only become unresolved. 6. Accepted aliases of stale groups become stale, 7. and so do open proposals.
    """
    stale = materialize(symbols.stale_groups(bindings, documents), "stale-symbols")
    stale = materialize(equivalents(links, stale).select(F.col("other_id").alias("symbol_id")).distinct(), "stale-groups")
    left = bindings.join(stale, "symbol_id", "left_anti")
    gone = stale.select(F.col("symbol_id").alias("_gone"))
    kept_links = links.join(gone, F.col("canonical") == F.col("_gone"), "left_anti").join(gone, F.col("linked") == F.col("_gone"), "left_anti")
    lost = bindings.join(stale, "symbol_id", "left_semi").select("doc_id", "start", "end", F.col("symbol_id").alias("_lost")).distinct()
    freed = occurrences.join(lost, ["doc_id", "start", "end"], "left")
    loses = F.coalesce(F.col("_lost") == F.col("symbol_id"), F.lit(False)) & (F.col("role") == "reference")
    freed = freed.withColumns({"role": F.when(loses, "unresolved").otherwise(F.col("role")), "symbol_id": F.when(~loses, F.col("symbol_id"))}).drop("_lost").distinct()
    bound = symbols.rebind(freed.join(documents.select("doc_id", "content_hash"), "doc_id", "left"), left).select(occurrences.columns)
    mark = stale.withColumn("_stale", F.lit(True))
    aged = lambda rows, was: rows.join(mark, "symbol_id", "left").withColumn("status", F.when(F.col("_stale") & (F.col("status") == was), "stale").otherwise(F.col("status"))).select(rows.columns)
    return {"bindings": left, "links": kept_links, "occurrences": bound, "aliases": aged(aliases, "accepted"), "proposals": aged(proposals, "open"), "stale": stale}


def admit_locations(locations: DataFrame, documents: DataFrame, occurrences: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bindings after, judged)`` for a batch of places that a language tool reported: ``locations(symbol_id, doc_id, start, end, name, content_hash)``.

    A symbol's places are admitted together or not at all: every one must be in a tracked document of the same content, at an occurrence of that name
    that no other symbol has. ``judged`` has each place's ``reason``.
    """
    d = documents.select("doc_id", F.col("content_hash").alias("_hash"))
    o = occurrences.groupBy("doc_id", "start", "end").agg(F.min("name").alias("_name"), F.collect_set("symbol_id").alias("_bound"))
    j = locations.join(d, "doc_id", "left").join(o, ["doc_id", "start", "end"], "left")
    reason = F.when(F.col("_hash").isNull(), "the document is not tracked").when(F.col("_hash") != F.col("content_hash"), "the document has changed").when(F.col("_name").isNull(), "no name stands there").when(F.col("_name") != F.col("name"), "another name stands there").when(F.exists("_bound", lambda x: x != F.col("symbol_id")), "it is bound to another symbol")
    judged = j.select(*locations.columns, reason.alias("reason")).withColumn("_bad", F.count("reason").over(W.partitionBy("symbol_id")))
    judged = materialize(judged.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_bad") > 0, "another place of the symbol was refused")).drop("_bad"), "admitted")
    fresh = judged.where("reason is null").select(bindings.columns).distinct()
    return bindings.join(fresh.select("symbol_id").distinct(), "symbol_id", "left_anti").unionByName(fresh), judged


def complete_symbols(symbol_table: DataFrame, occurrences: DataFrame, nodes: DataFrame, closure: DataFrame, bindings: DataFrame, links: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(symbol_id, complete)``: whether all of a symbol's uses are known, so that its alias can be shown.

    A symbol that a language tool has resolved (``resolved(symbol_id)``, with what links join to it) is. One with other bindings or links of such a tool is not.
    Else its scope must be closed, ``closure(symbol_id, node_id)``, and no unresolved use of its name may stand below that node in its document.
    """
    active = equivalents(links, resolved).select(F.col("other_id").alias("symbol_id")).distinct().withColumn("_active", F.lit(True))
    past = bindings.select("symbol_id").unionByName(links.select(F.col("canonical").alias("symbol_id"))).unionByName(links.select(F.col("linked").alias("symbol_id"))).distinct().withColumn("_past", F.lit(True))
    closed = symbol_table.join(closure.select("symbol_id", F.col("node_id").alias("_top")), "symbol_id").select("symbol_id", "doc_id", "name", "_top")
    # uses go up the tree by name and meet their symbols at the top node: pairs of all symbols and uses of a name would grow with the square
    unresolved = occurrences.where("role = 'unresolved'").join(closed.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_semi").select("node_id", "doc_id", "name")
    above = graph.reached_above(nodes, unresolved).withColumnRenamed("node_id", "_top")
    inside = closed.join(above, ["doc_id", "name", "_top"], "left_semi").select("symbol_id").distinct().withColumn("_open", F.lit(True))
    j = symbol_table.select("symbol_id").join(active, "symbol_id", "left").join(past, "symbol_id", "left").join(closure.select("symbol_id").distinct().withColumn("_closed", F.lit(True)), "symbol_id", "left").join(inside, "symbol_id", "left")
    return j.select("symbol_id", F.when(F.col("_active"), True).when(F.col("_past"), False).otherwise(F.col("_closed").isNotNull() & F.col("_open").isNull()).alias("complete"))


def unit_closures(symbol_table: DataFrame, includes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``(symbol_id, local, n_documents)``: whether a symbol's name is used only in the documents that its own one includes, directly or not.

    ``includes(doc_id, included)`` may have circles. All symbols' documents are closed together, once a document.
    """
    homes = symbol_table.select("doc_id").distinct()
    reach = materialize(graph.closures(includes.select(F.col("doc_id").alias("a"), F.col("included").alias("b")), homes.select(F.col("doc_id").alias("node"))), "units")
    sizes = reach.groupBy(F.col("start").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_documents"))
    uses = symbol_table.select("symbol_id", F.col("doc_id").alias("home"), "name").join(occurrences.select("name", "doc_id").distinct(), "name")
    outside = uses.join(reach.select(F.col("start").alias("home"), F.col("node").alias("doc_id")), ["home", "doc_id"], "left_anti").select("symbol_id").distinct().withColumn("_outside", F.lit(True))
    return symbol_table.join(sizes, "doc_id").join(outside, "symbol_id", "left").select("symbol_id", F.col("_outside").isNull().alias("local"), "n_documents")


def replace_documents(control: DataFrame, tables: dict[str, DataFrame], fresh: dict[str, DataFrame], documents: DataFrame, expected: int, key: str = "doc_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(control, tables)`` after some documents were parsed anew, if the control row's ``revision`` is as expected.

    Every table loses the rows of ``documents(key)`` and gets the fresh ones. ``StaleRevision`` leaves all as it was.
    """
    revision = require_revision(control.first()["revision"], expected)
    keys = documents.select(key).distinct()
    after = {name: rows.join(keys, key, "left_anti").unionByName(fresh[name]) if name in fresh else rows.join(keys, key, "left_anti") for name, rows in tables.items()}
    return control.withColumn("revision", F.lit(revision).cast(control.schema["revision"].dataType)), after


def scoped(rows: DataFrame, path: Column, scope: str) -> DataFrame:
    """Rows whose path is the scope or below it."""
    scope = scope.rstrip("/")
    return rows if not scope else rows.where((path == scope) | path.startswith(f"{scope}/"))


def preferred(rows: DataFrame, by: str, wanted: Column, order: str) -> DataFrame:
    """Of each group the row that is wanted, if there is one, else the first by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(wanted.desc(), order))).where("_n = 1").drop("_n")


def declared_in(occurrences: DataFrame) -> DataFrame:
    """``(name, doc_id, start)``: the first place that declares each name, by document and offset."""
    first = F.min(F.struct("doc_id", "start")).alias("_f")
    return occurrences.where("role = 'declaration'").groupBy("name").agg(first).select("name", "_f.doc_id", "_f.start")


def placed_symbols(symbol_table: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Symbols with the range of their nodes and the hash of their documents: the chain that every lookup of a symbol follows."""
    n = nodes.select("node_id", "start", "end")
    return symbol_table.join(n, "node_id").join(documents.select("doc_id", "content_hash"), "doc_id")
