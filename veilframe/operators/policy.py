"""Term tables: precedence, allowlists, aliases, and what is wrong with a policy.

A policy is small by nature (people write it), so its tables may be broadcast and read by the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.functions.matcher import Term
from veilframe.functions.text import derive_alias, is_run, normalize_term

PRECEDENCE = ("alias-registry", "dictionary", "denylist")
ENTRY = "source string, raw string, alias string"


def entries(spark: SparkSession, rows: list[tuple[str, str, str | None]]) -> DataFrame:
    """A policy as rows ``(source, raw, alias)``; denylist and allowlist entries have no alias."""
    return spark.createDataFrame(rows, ENTRY)


def term_table(policy: DataFrame, salt: str = "") -> DataFrame:
    """``(raw, normalized, replacement, policy_source)``: one term for each normalised spelling.

    Registry comes before dictionary before denylist, then the smaller spelling; allowlisted spellings are out. A
    denied term gets a derived alias.
    """
    ranked = policy.where(F.col("source").isin(*PRECEDENCE)).withColumn("normalized", normalize_term(F.col("raw"))).where("normalized <> ''")
    allowed = policy.where("source = 'allowlist'").select(normalize_term(F.col("raw")).alias("normalized"))
    order = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("source"))
    first = F.row_number().over(W.partitionBy("normalized").orderBy(order, "raw"))
    kept = ranked.join(F.broadcast(allowed), "normalized", "left_anti").withColumn("n", first).where("n = 1")
    return kept.select("raw", "normalized", F.coalesce("alias", derive_alias(F.col("raw"), salt)).alias("replacement"), F.col("source").alias("policy_source"))


def collect_terms(table: DataFrame) -> list[Term]:
    """The table as Python objects for matchers; a documented reduction, as a policy is small."""
    return [Term(r["raw"], r["normalized"], r["replacement"], r["policy_source"]) for r in table.orderBy("raw").collect()]


def term_array(table: DataFrame):  # noqa: ANN201
    """A term table as one literal ``array<struct<raw, normalized, alias>>``, for tests of each row against all terms; a policy is small."""
    rows = [{"raw": t.raw, "normalized": t.normalized, "alias": _plain(t.replacement)} for t in collect_terms(table)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<raw:string,normalized:string,alias:string>>")


def _plain(term: str) -> str:
    """What ``normalize_term`` makes of one term."""
    return "".join(c.lower() if c.isascii() else c for c in term if c not in "_-")


def policy_violations(policy: DataFrame, salt: str = "") -> DataFrame:
    """``(check, raw, other)``: entries that can never match, aliases of two terms, aliases that hold a term."""
    bad_term = policy.where(~is_run(F.col("raw"))).select(F.lit("unmatchable term").alias("check"), "raw", F.lit(None).cast("string").alias("other"))
    bad_alias = policy.where(F.col("alias").isNotNull() & ~is_run(F.col("alias"))).select(F.lit("unmatchable alias").alias("check"), "raw", F.col("alias").alias("other"))
    terms = term_table(policy, salt).withColumn("alias_norm", normalize_term(F.col("replacement")))
    a, b = terms.alias("a"), terms.alias("b")
    shared = a.join(b, (F.col("a.alias_norm") == F.col("b.alias_norm")) & (F.col("a.raw") > F.col("b.raw"))).groupBy("a.raw").agg(F.min("b.raw").alias("other")).select(F.lit("shared alias").alias("check"), "raw", "other")
    # every pair of a few terms is looked at: the terms go along as one literal
    known = F.filter(term_array(terms), lambda t: F.contains(F.col("alias_norm"), t["normalized"]))
    dirty = terms.select("raw", F.explode(known).alias("t")).select(F.lit("alias holds a term").alias("check"), "raw", F.col("t.raw").alias("other"))
    return bad_term.unionByName(bad_alias).unionByName(shared).unionByName(dirty)


#: Settings of a policy and the range that each must be in (fixed values).
RANGES = {"confidence_threshold": (0.0, 1.0), "max_file_bytes": (1.0, float(1 << 40)), "chunk_lines": (1.0, 100_000.0), "chunk_overlap": (0.0, 99_999.0)}


def setting_violations(settings: DataFrame) -> DataFrame:
    """``(check, raw, other)`` for ``settings(name, value)`` that are unknown, no number, or outside their range; settings are written by people and few."""
    low = F.create_map(*(x for n, (a, _) in RANGES.items() for x in (F.lit(n), F.lit(a))))
    high = F.create_map(*(x for n, (_, b) in RANGES.items() for x in (F.lit(n), F.lit(b))))
    a, b, v = F.try_element_at(low, F.col("name")), F.try_element_at(high, F.col("name")), F.col("value").cast("double")
    check = F.when(a.isNull(), "unknown setting").when(v.isNull() | F.isnan(v), "no number").when((v < a) | (v > b), "out of range")
    return settings.select(check.alias("check"), F.col("name").alias("raw"), v.cast("string").alias("other")).where("check is not null")


def ambiguous_aliases(pairs: DataFrame) -> DataFrame:
    """``(alias_norm, originals)`` for aliases that stand for more than one original."""
    known = pairs.groupBy(normalize_term(F.col("alias")).alias("alias_norm")).agg(F.array_sort(F.collect_set(normalize_term(F.col("original")))).alias("originals"))
    return known.where(F.size("originals") > 1)
