"""Checks of invariants. Each yields rows ``(check, key, detail)`` for what is wrong; none means sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.matcher import Term
from veilframe.functions.text import normalize_term
from veilframe.operators.render import alias_collisions, leaks, render, reverse, tiling_faults


def _rows(check: str, found: DataFrame, key: str, detail) -> DataFrame:  # noqa: ANN001
    return found.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def verify_renders(rendered: DataFrame, terms: list[Term], term_table: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Reversal gives the original, spans tile both texts, no term is left, no alias occurs by itself."""
    flat = rendered.withColumn("_rendered", F.col("map.rendered"))
    parts = [
        _rows("reversal", rendered.withColumn("_back", reverse(rendered)).where(~F.col("_back").eqNullSafe(F.col(text))), key, F.lit("")),
        _rows("tiling", tiling_faults(rendered, key, text), key, F.col("fault")),
        _rows("leak", leaks(flat, terms, "_rendered", key), key, F.col("term")),
        _rows("collision", alias_collisions(rendered, term_table, text, key), key, F.col("run")),
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_workspace(state: DataFrame, docs: DataFrame, mirror: DataFrame, terms: list[Term], key: str = "doc_id", text: str = "text") -> DataFrame:
    """A whole workspace against its state (``indexing.STATE``): ``(check, key, detail)`` for each document that fails one.

    Source: the text is what was indexed. Mirror: the present text is the stored render, no text is there that nothing tracks, none is missing. Map: it
    reverses, tiles, has the stored hash, as many replacements as a fresh render. Leak: no term is left in the mirror.
    """
    s = state.select(F.col(key).alias("_key"), "input_hash", "rendered_hash", "map")
    joined = docs.select(key, text).join(s, F.col(key) == F.col("_key"))
    fresh = render(joined.withColumnRenamed("map", "_stored"), terms, text)
    counted = fresh.select(key, F.size("_stored.replacements").alias("a"), F.size("map.replacements").alias("b"), F.col("_stored.rendered").eqNullSafe(F.col("map.rendered")).alias("same"))
    shown = mirror.select(F.col(key).alias("_m"), "present").join(s, F.col("_m") == F.col("_key"), "full_outer")
    nothing = F.lit("")
    parts = [
        _rows("source changed", joined.where(F.sha2(text, 256) != F.col("input_hash")), key, nothing),
        _rows("source missing", s.join(docs.select(key), F.col("_key") == F.col(key), "left_anti"), "_key", nothing),
        _rows("mirror changed", shown.where(F.sha2("present", 256) != F.col("rendered_hash")), "_m", nothing),
        _rows("mirror missing", shown.where("_m is null"), "_key", nothing),
        _rows("mirror untracked", shown.where("_key is null"), "_m", nothing),
        _rows("stored hash", s.where(F.sha2("map.rendered", 256) != F.col("rendered_hash")), "_key", nothing),
        _rows("replacement count", counted.where("a <> b"), key, F.concat_ws(" of ", "a", "b")),
        _rows("render differs", counted.where("not same"), key, nothing),
        _rows("reversal", joined.where(~F.coalesce(reverse(joined) == F.col(text), F.lit(False))), key, nothing),
        _rows("tiling", tiling_faults(joined, key, text), key, F.col("fault")),
        _rows("leak", leaks(mirror, terms, "present", key), key, F.col("term")),
    ]
    return reduce(DataFrame.unionByName, parts)


def verify_symbols(symbol_table: DataFrame, occurrences: DataFrame, nodes: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """A symbol index against itself: ``(check, key, detail)``.

    Keys are unique; nodes, symbols and occurrences have their documents, nodes their parents, symbols their nodes, occurrences their nodes and symbols, aliases
    their symbols; declarations are bound, unresolved ones are not; every symbol is declared; ranges are in order and within their parents'; an alias stands for one original.
    """
    nothing = F.lit("")
    o = occurrences.withColumn("_at", F.concat_ws(":", "doc_id", "start", "end"))
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    accepted = aliases.where("status = 'accepted'")
    originals = accepted.groupBy(normalize_term(F.col("alias")).alias("_a")).agg(F.count_distinct(normalize_term(F.col("original"))).alias("n")).where("n > 1")
    parts = [
        *(_rows("duplicate key", duplicate_keys(rows, k), k, F.lit(k)) for rows, k in ((symbol_table, "symbol_id"), (nodes, "node_id"), (documents, "doc_id"), (accepted, "symbol_id"))),
        *(_rows("without document", orphans(rows, documents, "doc_id"), k, F.lit(k)) for rows, k in ((nodes, "node_id"), (symbol_table, "symbol_id"), (o, "_at"))),
        _rows("without parent", orphans(nodes.where("parent_id is not null"), nodes.select(F.col("node_id").alias("parent_id")), "parent_id"), "node_id", nothing),
        _rows("without node", orphans(symbol_table, nodes, "node_id"), "symbol_id", nothing),
        _rows("without node", orphans(o, nodes, "node_id"), "_at", nothing),
        _rows("without symbol", orphans(o.where("symbol_id is not null"), symbol_table, "symbol_id"), "_at", nothing),
        _rows("without symbol", orphans(accepted, symbol_table, "symbol_id"), "symbol_id", F.lit("alias")),
        _rows("role", o.where("(role IN ('declaration', 'reference') AND symbol_id IS NULL) OR (role IN ('unresolved', 'external') AND symbol_id IS NOT NULL)"), "_at", F.col("role")),
        _rows("undeclared", orphans(symbol_table, o.where("role = 'declaration'").select("symbol_id"), "symbol_id"), "symbol_id", nothing),
        _rows("range", o.where(F.col("start") > F.col("end")), "_at", nothing),
        _rows("outside its parent", nodes.join(parents, "parent_id").where((F.col("start") < F.col("_s")) | (F.col("end") > F.col("_e"))), "node_id", nothing),
        _rows("shared alias", originals, "_a", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no parent has, null keys included."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have: Spark enforces none."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def different_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with their side, repeated rows counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
