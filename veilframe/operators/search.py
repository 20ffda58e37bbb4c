"""Literal search and listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import lines, matches_glob
from veilframe.operators.paths import resolve

DEFAULT_LIMIT, HARD_LIMIT = 200, 1000


def search(docs: DataFrame, query: str, text: str = "text", key: str = "doc_id", glob: str | None = None) -> DataFrame:
    """``(key, line, column, line_text)`` of every non-overlapping occurrence; line and column count from 1, columns in code points.

    Texts without the query never leave the scan.
    """
    if not query:
        raise ValueError("the query must not be empty")
    hits = docs.where(F.contains(text, F.lit(query)))
    if glob is not None:
        hits = hits.where(matches_glob(F.col(key), glob))
    each = hits.select(key, F.posexplode(lines(F.col(text))).alias("line", "line_text")).where(F.contains("line_text", F.lit(query)))
    parts = F.split("line_text", re.escape(query) if "\\E" in query else f"\\Q{query}\\E")
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + len(query)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found"))
    # the part after the last occurrence leads to none
    columns = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda a: a["found"])
    found = each.select(key, (F.col("line") + 1).cast("long").alias("line"), F.explode(columns).alias("column"), "line_text")
    return found.withColumn("column", F.col("column").cast("long"))


def search_capped(docs: DataFrame, query: str, limit: int | None = None, **settings) -> DataFrame:  # noqa: ANN003
    """The first matches in order, with ``truncated`` on all rows if there are more. The limit is the feature: 1 to 1000, else 200."""
    n = min(max(DEFAULT_LIMIT if limit is None else limit, 1), HARD_LIMIT)
    key = settings.get("key", "doc_id")
    first = search(docs, query, **settings).orderBy(key, "line", "column").limit(n + 1)
    from pyspark.sql.window import Window as W

    whole = W.partitionBy()
    ranked = first.withColumns({"_n": F.row_number().over(W.orderBy(key, "line", "column")), "truncated": F.count(F.lit(1)).over(whole) > n})
    return ranked.where(F.col("_n") <= n).drop("_n")


def list_documents(docs: DataFrame, path: str, glob: str | None = None) -> DataFrame:
    """Paths that the glob matches, all without one, in order."""
    return (docs if glob is None else docs.where(matches_glob(F.col(path), glob))).select(path).orderBy(path)


def lookup(rows: DataFrame, keys: list, key: str = "doc_id") -> DataFrame:
    """Rows of some stated keys; the test reaches the scan."""
    return rows.where(F.col(key).isin(list(keys)))


def read_documents(tracked: DataFrame, mapped: DataFrame, asked: DataFrame) -> DataFrame:
    """``(asked, path, rendered)`` of asked paths: projected spellings first, then real ones; what is not tracked has no text.

    ``tracked(path, rendered)``; ``mapped`` as ``paths.path_map``. Whether a path is tracked is settled before any text is read.
    """
    found = resolve(asked, mapped).select("asked", F.col("real").alias("path"))
    return found.join(tracked.select("path", "rendered"), "path", "left").select("asked", "path", "rendered")


def find_symbols(symbols: DataFrame, aliases: DataFrame, replacements: DataFrame, query: str, limit: int = HARD_LIMIT) -> DataFrame:
    """Symbols whose name as shown (accepted alias, else lexical replacement, else own name) holds the query in any case.

    ``symbols(symbol_id, doc_id, name, start)``, ``aliases(symbol_id, alias, status)``, ``replacements(doc_id, original_start, sanitized_text)``.
    """
    accepted = aliases.where("status = 'accepted'").select("symbol_id", "alias")
    shown = symbols.join(accepted, "symbol_id", "left").join(replacements.select("doc_id", F.col("original_start").alias("start"), "sanitized_text"), ["doc_id", "start"], "left")
    named = shown.withColumn("shown", F.coalesce("alias", "sanitized_text", "name"))
    # ranges and qualified names are shown by render.project_ranges and symbols.project_qualified
    return named.where(F.contains(F.lower("shown"), F.lower(F.lit(query)))).select("symbol_id", "doc_id", "shown").orderBy("shown", "symbol_id").limit(min(max(limit, 1), HARD_LIMIT))
