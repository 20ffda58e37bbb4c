"""Rendering with span maps, reversal, hits, leaks and collisions over a table of documents."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.functions.matcher import Term
from veilframe.functions.text import digest, normalize_term, pieces, runs, term_pattern
from veilframe.sources.scratch import materialize, ship

REPLACEMENT = "struct<id:long,category:string,original_text:string,sanitized_text:string,policy_source:string,original_start:long,original_end:long,sanitized_start:long,sanitized_end:long>"
SPAN = "struct<replacement_id:long,original_start:long,original_end:long,sanitized_start:long,sanitized_end:long,original_line_start:long,sanitized_line_start:long>"
MAP = f"struct<rendered:string,replacements:array<{REPLACEMENT}>,spans:array<{SPAN}>>"


#: Protected names that are sent to the workers at most; a larger table is joined instead.
SHIELD_ROWS = 200_000
Protected = frozenset | DataFrame


def _shield(docs: DataFrame, terms: list[Term], text: str, protected: Protected):  # noqa: ANN202
    """How protected names reach the matcher: a set for all documents (a broadcast variable), or a column with each document's own.

    A table of names (``name``) grows with the corpus. Up to ``SHIELD_ROWS`` it is broadcast; beyond, each document's runs that hold a term
    are joined with it, and only those that are protected go along with the text.
    """
    sc = docs.sparkSession.sparkContext
    if isinstance(protected, frozenset):
        return docs, sc.broadcast(protected), None
    few = protected.select("name").distinct().limit(SHIELD_ROWS + 1).collect()
    if len(few) <= SHIELD_ROWS:
        return docs, sc.broadcast(frozenset(r["name"] for r in few)), None
    row = "__shield_row"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "shield-rows")
    suspects = F.filter(F.array_distinct(runs(F.col(text))), lambda r: r.rlike("|".join(term_pattern(t.normalized) for t in terms)))
    held = numbered.select(row, F.explode(suspects).alias("name")).join(protected.select("name").distinct(), "name").groupBy(row).agg(F.collect_list("name").alias("__shield"))
    return numbered.join(held, row, "left").drop(row), sc.broadcast(frozenset()), "__shield"


def render(docs: DataFrame, terms: list[Term], text: str = "text", language: Column | None = None, protected: Protected = frozenset()) -> DataFrame:
    """Adds ``map``: the rendered text, its replacements, and the spans that tile both texts. Null texts give null.

    One Arrow pass over each text and no shuffle, unless ``protected`` is a table too large to send. Different runs are matched once a worker
    process and remembered; maps leave it as Arrow arrays.
    """
    ship(docs.sparkSession)
    policy, (shielded, names, own) = tuple(terms), _shield(docs, terms, text, protected)

    @F.arrow_udf(MAP)
    def rendered(bodies: pa.Array, languages: pa.Array, spared: pa.Array) -> pa.Array:
        from veilframe.functions.matcher import matcher_for

        own_names = [frozenset(x.encode() for x in s or ()) for s in spared.to_pylist()]
        return matcher_for(policy, names.value).render_all(bodies.to_pylist(), languages.to_pylist(), own_names)

    spared = F.col(own) if own else F.lit(None).cast("array<string>")
    made = shielded.withColumn("map", rendered(F.col(text), language if language is not None else F.lit("text"), spared))
    return made.drop(own) if own else made


def replace_terms(docs: DataFrame, terms: list[Term], text: str = "text", exempt: bool = True, protected: frozenset[str] = frozenset()) -> Column:
    """A column with all terms replaced and no map. ``exempt=False`` spares neither keywords nor protected names."""
    ship(docs.sparkSession)
    policy, names = tuple(terms), docs.sparkSession.sparkContext.broadcast(protected)

    @F.arrow_udf("string")
    def replaced(bodies: pa.Array) -> pa.Array:
        from veilframe.functions.matcher import matcher_for

        matcher = matcher_for(policy, names.value, exempt)
        return pa.array([None if b is None else matcher.replace(b) for b in bodies.to_pylist()], pa.string())

    return replaced(F.col(text))


def render_placed(docs: DataFrame, replacements: DataFrame, text: str = "text", key: str = "doc_id", language: Column | None = None) -> DataFrame:
    """Adds ``map`` from replacements that are given: ``(key, start, end, replacement, policy_source)`` in bytes, none of which overlap.

    A document with one that overlaps, is out of bounds, cuts a character or holds a line end has a null map (``placement_faults`` says why).
    """
    ship(docs.sparkSession)
    faulty = placement_faults(docs, replacements, text, key).select(key).distinct()
    given = replacements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement", "policy_source"))).alias("__given"))
    joined = docs.join(given, key, "left").join(faulty.withColumn("__faulty", F.lit(True)), key, "left")

    @F.arrow_udf(MAP)
    def placed(bodies: pa.Array, languages: pa.Array, rows: pa.Array) -> pa.Array:
        from veilframe.functions.matcher import Placed

        found = rows.to_pylist()
        sources = sorted({r["policy_source"] or "" for own in found for r in own or ()})
        number = {s: i for i, s in enumerate(sources)}
        texts = bodies.to_pylist()
        given = [[(r["start"], r["end"], number[r["policy_source"] or ""], r["replacement"]) for r in own or ()] for own, t in zip(found, texts, strict=True) if t is not None]
        return Placed(sources, given).render_all(texts, languages.to_pylist())

    body = F.when(F.col("__faulty").isNull(), F.col(text))
    made = joined.withColumn("map", placed(body, language if language is not None else F.lit("text"), F.col("__given")))
    return made.withColumn("map", F.when(body.isNotNull(), F.col("map"))).drop("__given", "__faulty")


def placement_faults(docs: DataFrame, replacements: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, start, fault)`` of given replacements that cannot be made: overlap, out of bounds, no whole characters, another text than stated, line end.

    ``replacements(key, start, end, replacement[, original_text])``.
    """
    raw = F.encode(F.col(text), "UTF-8")
    part = F.substring(raw, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    whole = F.is_valid_utf8(part.cast("string")) & F.is_valid_utf8(F.substring(raw, F.lit(1), F.col("start").cast("int")).cast("string"))
    before = F.max("end").over(W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    stated = (part.cast("string") != F.col("original_text")) if "original_text" in replacements.columns else F.lit(False)
    fault = (
        F.when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.octet_length(text)), "out of bounds")
        .when(F.col("start") < F.col("_before"), "overlap")
        .when(~whole, "no whole characters")
        .when(stated, "another text")
        .when(F.col("replacement").contains("\n"), "line end")
    )
    ranked = replacements.withColumn("_before", before)
    return ranked.join(docs.select(key, text), key).select(key, "start", fault.alias("fault")).where("fault is not null")


def store_maps(rendered: DataFrame) -> Column:
    """Span maps as JSON documents, for exchange."""
    return F.to_json("map")


def load_maps(stored: Column) -> Column:
    """Span maps from JSON documents; null where one does not parse or lacks its texts."""
    found = F.from_json(stored, MAP)
    return F.when(found["rendered"].isNotNull(), found)


def project_ranges(rows: DataFrame, rendered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with byte ranges ``(key, start, end)`` of originals, such as nodes or occurrences, with the ranges of the render beside them.

    Adds ``shown_start`` and ``shown_end``: an edge within a replacement moves to the replacement's edge.
    """
    joined = rows.join(rendered.select(F.col(key), F.col("map.spans").alias("__spans")), key)
    inside = lambda at, end: F.get(F.filter("__spans", lambda s: (s["original_start"] <= at) & (at < s["original_end"]) if not end else (s["original_start"] < at) & (at <= s["original_end"])), F.lit(0))
    edge = lambda at, s, side: F.when(at == 0, F.lit(0)).when(s["replacement_id"].isNull(), s["sanitized_start"] + at - s["original_start"]).otherwise(s[side])
    begin = F.coalesce(edge(F.col("start"), inside(F.col("start"), False), "sanitized_start"), F.get("__spans", F.size("__spans") - 1)["sanitized_end"])
    stop = edge(F.col("end"), inside(F.col("end"), True), "sanitized_end")
    return joined.withColumns({"shown_start": begin.cast("long"), "shown_end": stop.cast("long")}).drop("__spans")


def output_pairs(terms: list[Term], aliases: list[tuple[str, str]], protected: frozenset[str] = frozenset()) -> list[Term]:
    """The table that output is redacted by: the policy's terms, and ``(original, alias)`` pairs of accepted names.

    Pairs whose original is its alias, has fewer than two characters when normalised, or is protected are left out; a spelling that the policy has keeps its policy's alias.
    """
    plain = lambda s: s.replace("_", "").replace("-", "").lower()
    made = {t.normalized: t for t in terms}
    for original, alias in aliases:
        n = plain(original)
        if len(n) >= 2 and n != plain(alias) and original not in protected:
            made.setdefault(n, Term(original, n, alias, "alias"))
    return sorted(made.values(), key=lambda t: t.raw)


def reverse(rendered: DataFrame) -> Column:
    """The original text from a ``map``: its spans in order, each replacement's own text in place of its alias."""
    raw = F.encode("map.rendered", "UTF-8")
    part = lambda s: F.decode(F.substring(raw, (s["sanitized_start"] + 1).cast("int"), (s["sanitized_end"] - s["sanitized_start"]).cast("int")), "UTF-8")
    return F.array_join(F.transform("map.spans", lambda s: F.when(s["replacement_id"].isNull(), part(s)).otherwise(F.get("map.replacements", s["replacement_id"].cast("int"))["original_text"])), "")


def replacements_of(docs: DataFrame, terms: list[Term], text: str = "text", id_col: str = "doc_id", language: Column | None = None, protected: frozenset[str] = frozenset()) -> DataFrame:
    """What ``audit`` of a render lists, without rendering: one row for each replacement that the terms would make."""
    ship(docs.sparkSession)
    policy, names = tuple(terms), docs.sparkSession.sparkContext.broadcast(protected)

    @F.arrow_udf(f"array<{REPLACEMENT}>")
    def listed(bodies: pa.Array, languages: pa.Array) -> pa.Array:
        from veilframe.functions.matcher import matcher_for

        return matcher_for(policy, names.value).render_all(bodies.to_pylist(), languages.to_pylist(), whole=False)

    found = listed(F.col(text), language if language is not None else F.lit("text"))
    return docs.select(id_col, F.explode(found).alias("r")).select(id_col, "r.*")


def audit(rendered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each replacement, keyed by document and ordinal."""
    return rendered.select(id_col, F.explode("map.replacements").alias("r")).select(id_col, "r.*")


def stable_keys(listed: DataFrame, path: Column) -> DataFrame:
    """Adds the key by which a replacement is known between renders."""
    return listed.withColumn("stable_key", digest(path, F.col("category"), F.col("original_start").cast("string"), F.col("original_text")))


def tiling_faults(rendered: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fault)`` where spans leave a gap, overlap, or do not cover both texts."""
    ends = F.aggregate("map.spans", F.struct(F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("s"), F.lit(True).alias("ok")), lambda a, s: F.struct(s["original_end"].alias("o"), s["sanitized_end"].alias("s"), (a["ok"] & (a["o"] == s["original_start"]) & (a["s"] == s["sanitized_start"])).alias("ok")))
    checked = rendered.select(id_col, ends.alias("e"), F.octet_length(text).alias("o"), F.octet_length("map.rendered").alias("s"))
    return checked.select(id_col, F.when(~F.col("e.ok"), "gap or overlap").when((F.col("e.o") != F.col("o")) | (F.col("e.s") != F.col("s")), "not covered").alias("fault")).where("fault is not null")


def edit_conflicts(rendered: DataFrame, start: Column, end: Column) -> Column:
    """Whether an edit of rendered bytes touches a replacement: strictly inside for an empty one, by overlap otherwise."""
    return F.exists("map.replacements", lambda r: F.when(start == end, (start > r["sanitized_start"]) & (start < r["sanitized_end"])).otherwise((start < r["sanitized_end"]) & (end > r["sanitized_start"])))


def project_offset(offset: Column, end: bool = False) -> Column:
    """A rendered offset for an original one; inside a replacement its start, or with ``end`` its end."""
    inside = F.filter("map.spans", lambda s: (s["original_start"] <= offset) & (offset < s["original_end"]) if not end else (s["original_start"] < offset) & (offset <= s["original_end"]))[0]
    edge = inside["sanitized_end"] if end else inside["sanitized_start"]
    return F.when(inside["replacement_id"].isNull(), inside["sanitized_start"] + offset - inside["original_start"]).otherwise(edge)


def term_hits(docs: DataFrame, terms: list[Term], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, term, hits)`` by one regular expression a term, in the JVM; overlaps between terms are not resolved."""
    counts = F.array(*(F.struct(F.lit(t.raw).alias("term"), F.regexp_count(text, F.lit(term_pattern(t.normalized))).cast("long").alias("hits")) for t in terms))
    return docs.select(id_col, F.explode(counts).alias("h")).select(id_col, "h.term", "h.hits").where("hits > 0")


def leaks(docs: DataFrame, terms: list[Term], text: str, id_col: str = "doc_id", protected: frozenset[str] = frozenset()) -> DataFrame:
    """``(id, byte_offset, term, run)``: each term that is still in a text, outside keywords and protected names.

    Only texts that any term's pattern matches are looked at closely.
    """
    ship(docs.sparkSession)
    if not terms:
        return docs.select(id_col).limit(0).selectExpr(id_col, "0L as byte_offset", "'' as term", "'' as run")

    policy, names = tuple(terms), docs.sparkSession.sparkContext.broadcast(protected)

    @F.arrow_udf("array<struct<byte_offset:long,term:string,run:string>>")
    def found(bodies: pa.Array) -> pa.Array:
        from veilframe.functions.matcher import _RUN, matcher_for

        matcher, ends, at, term, held = matcher_for(policy, names.value), [0], [], [], []
        for b in bodies.to_pylist():
            for m in _RUN.finditer((b or "").encode()):
                if matcher.selected(m[0]):
                    run = m[0].decode()
                    for a, _, k in matcher.hits(m[0]):
                        at.append(m.start() + a)
                        term.append(matcher.terms[k].raw)
                        held.append(run)
            ends.append(len(at))
        rows = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(term, pa.string()), pa.array(held, pa.string())], ["byte_offset", "term", "run"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    suspects = docs.where(F.col(text).rlike("|".join(term_pattern(t.normalized) for t in terms)))
    return suspects.select(id_col, F.explode(found(F.col(text))).alias("l")).select(id_col, "l.*")


def alias_collisions(docs: DataFrame, terms: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, run, replacement)``: words of the originals that already read like an alias."""
    words = docs.select(id_col, F.explode(F.array_distinct(runs(F.col(text)))).alias("run")).withColumn("n", normalize_term(F.col("run")))
    aliases = terms.select("replacement", normalize_term(F.col("replacement")).alias("n"))
    return words.join(F.broadcast(aliases), "n").select(id_col, "run", "replacement")


def word_positions(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, pos, piece, start, is_run)``: the lossless cut of each text with byte offsets.

    The relational form of tokenising, for joins; one document's pieces meet in one window.
    """
    cut = docs.select(id_col, F.posexplode(pieces(F.col(text))).alias("pos", "piece"))
    before = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return cut.select(id_col, F.col("pos").cast("long").alias("pos"), "piece", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)).cast("long").alias("start"), F.col("piece").rlike("^[A-Za-z0-9_]").alias("is_run"))


def running_offsets(replacements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``shifted_start``: where each replacement begins once all before it are made."""
    before = W.partitionBy(id_col).orderBy("original_start").rowsBetween(W.unboundedPreceding, -1)
    delta = F.octet_length("sanitized_text") - F.octet_length("original_text")
    return replacements.withColumn("shifted_start", F.col("original_start") + F.coalesce(F.sum(delta).over(before), F.lit(0)))


def without_overlap(intervals: DataFrame, blockers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Intervals ``(key, start, end)`` that overlap no blocker of the same key (half open)."""
    b = blockers.select(F.col(key).alias("b_key"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return intervals.join(b, (F.col(key) == F.col("b_key")) & (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start")), "left_anti")


def containing(points: DataFrame, intervals: DataFrame, key: str = "doc_id") -> DataFrame:
    """Points ``(key, at)`` with the interval of their key that holds them, if any."""
    i = intervals.select(F.col(key).alias("i_key"), F.col("start"), F.col("end"))
    return points.join(i, (F.col(key) == F.col("i_key")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")), "left").drop("i_key")


def protected_union(docs: DataFrame, language: Column, text: str = "text") -> DataFrame:
    """``(name)``: what any document protects, the one barrier of an index pass; a small set, made by distinct."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def names(bodies: pd.Series, languages: pd.Series) -> pd.Series:
        from veilframe.functions.matcher import protected_names

        return pd.Series([sorted(protected_names(b or "", lang)) for b, lang in zip(bodies, languages, strict=True)], dtype="object")

    return docs.select(F.explode(names(F.col(text), language)).alias("name")).distinct()


def protected_conflicts(names: DataFrame, terms: list[Term]) -> DataFrame:
    """``(name, term)``: protected names that hold a denied term."""
    denied = [t for t in terms if t.policy_source == "denylist"]
    held = F.array_compact(F.array(*(F.when(F.col("name").rlike(term_pattern(t.normalized)), F.lit(t.raw)) for t in denied))) if denied else F.array().cast("array<string>")
    return names.select("name", F.explode(held).alias("term"))


def replace_longest(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Exact multi-pattern replacement, leftmost and longest, case-sensitive.

    One alternation, longest first, cuts the text into matches and the rest; a map looks the matches up.
    """
    import re as _re

    ordered = sorted({a: b for a, b in pairs if a}.items(), key=lambda p: (-len(p[0]), p[0]))
    if not ordered:
        return text
    pattern = "|".join(_re.escape(a) for a, _ in ordered)
    known = F.create_map(*(F.lit(x) for pair in ordered for x in pair))
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?:{pattern})|(?:(?!{pattern}).)+"), F.lit(0))
    return F.array_join(F.transform(cut, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")
