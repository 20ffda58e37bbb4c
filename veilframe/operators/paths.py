"""Projection of paths through the term table, and the proof that it can be reversed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.matcher import Term
from veilframe.operators.render import replace_terms


def project_paths(paths: DataFrame, terms: list[Term], path: str = "path") -> DataFrame:
    """Adds ``projected``: directory names and the file's stem with terms replaced, its last extension kept."""
    p = F.col(path)
    # a name's stem and extension: the extension of the last part only, and not that of a name that begins with its only dot
    suffix = F.regexp_extract(p, r"(?:^|/)[^/]+(\.[^./]*)$", 1)
    cut = paths.withColumn("_stem", F.substring(p, F.lit(1), F.length(p) - F.length(suffix))).withColumn("_suffix", suffix)
    return cut.withColumn("projected", F.concat(replace_terms(cut, terms, "_stem", exempt=False), "_suffix")).drop("_stem", "_suffix")


def prefixes(path: Column) -> Column:
    """The path and all its directories, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_map(projected: DataFrame, path: str = "path") -> DataFrame:
    """``(real, projected, kind)`` of every file and directory."""
    both = F.arrays_zip(prefixes(F.col(path)).alias("real"), prefixes(F.col("projected")).alias("projected"))
    files = projected.select(F.col(path).alias("_path"), F.explode(both).alias("b"))
    return files.select("b.real", "b.projected", F.when(F.col("b.real") == F.col("_path"), "file").otherwise("directory").alias("kind")).distinct()


def path_collisions(mapped: DataFrame) -> DataFrame:
    """``(key, n)``: projected paths, compared without case, that stand for several real ones or for a file and a directory."""
    return mapped.groupBy(F.lower("projected").alias("key")).agg(F.count_distinct(F.struct("real", "kind")).alias("n")).where("n > 1")


def resolve(requests: DataFrame, mapped: DataFrame, asked: str = "asked") -> DataFrame:
    """Adds ``real``: by projected spelling first (any case), then by real spelling; null for neither."""
    by_projected = mapped.groupBy(F.lower("projected").alias("p_key")).agg(F.min("real").alias("p_real"))
    by_real = mapped.select(F.col("real").alias("r_real")).distinct()
    joined = requests.join(by_projected, F.lower(asked) == F.col("p_key"), "left").join(by_real, F.col(asked) == F.col("r_real"), "left")
    return joined.withColumn("real", F.coalesce("p_real", "r_real")).drop("p_key", "p_real", "r_real")


def resolve_new(requests: DataFrame, mapped: DataFrame, asked: str = "asked", terms: list[Term] | None = None) -> DataFrame:
    """``(asked, real)`` for paths that do not exist yet: the real spelling of the longest known directory, and the rest as it is.

    Paths below a known file are left out. A path without a known directory stays as it is. With ``terms``, the rest must be neutral: a path whose new
    part would be projected to something else has no real one.
    """
    wanted = requests.select(asked).distinct()
    each = wanted.select(asked, F.explode(prefixes(F.col(asked))).alias("prefix"))
    keys = mapped.groupBy(F.lower("projected").alias("key")).agg(F.min("real").alias("real"), F.min("kind").alias("kind"))
    hits = each.join(keys, F.lower("prefix") == F.col("key")).groupBy(asked).agg(F.max_by(F.struct("prefix", "real", "kind"), F.length("prefix")).alias("b"))
    joined = wanted.join(hits, asked, "left").where(F.coalesce(F.col("b.kind") == "directory", F.lit(True)))
    tail = F.when(F.col("b").isNull(), F.col(asked)).otherwise(F.substring(F.col(asked), F.length("b.prefix") + 1, F.length(asked)))
    parts = joined.withColumn("_tail", tail)
    real = F.concat(F.coalesce("b.real", F.lit("")), "_tail")
    if terms is None:
        return parts.select(asked, real.alias("real"))
    shown = project_paths(parts, terms, "_tail")
    return shown.select(asked, F.when(F.col("projected") == F.col("_tail"), real).alias("real"))
