"""Quality rules with adaptive thresholds (operator 5), by DataFrame functions only.

Fixed rules drop what is broken anywhere. The others are fences around what is usual for a language and source: for
each of them the quartiles of a measure come from a quantile sketch, and a text is dropped if it lies several
quartile ranges beyond. A sketch is a table ``(cell, measure, bucket, number)``: buckets are exact up to 32 and then
split each power of two in 16, so a quantile is known within 1/16 of its value and buckets of any split of the
rows merge by addition. That makes sketches pre-aggregated before their shuffle and deterministic.
Cells with few rows take the merged sketch of their language, and languages with few rows that of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.llm.shared import WORD, materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Quartile ranges beyond the upper (lower) quartile.
FENCE = 8
#: Rows that a cell needs for quartiles of its own.
SUPPORT = 50
#: Measures in thousandths (repeated lines in ten-thousandths) and the least quartile range each is given, so that a constant measure makes no fence of width 0. With
#: ``FENCE`` they leave each measure room to reject what the fixed rules let through: these allow 200 of repeats, a fence begins at 80.
MEASURES = {"symbols": 25, "repeats": 10, "dup_lines": 10, "word_length": 300}
TWO_SIDED = ("word_length",)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once: a lambda's argument is not expanded, a column expression is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words in order; an empty array for a null text or one without words."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0)), F.array().cast("array<string>"))


def repeat_words(words: Column, n: int = 5) -> Column:
    """How many words stand in ``n``-word windows that the text has twice or more.

    Hashes of all windows tell most texts without a repeated window at once. For the rest the windows themselves
    are sorted with their places, those equal to a neighbour kept, and the union of their words counted.
    """

    def of_windows(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - (n - 1))
        hashes = _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(n)))))
        suspicious = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(suspicious, covered(w, places)).otherwise(F.lit(0).cast("long"))

    def covered(w: Column, places: Column) -> Column:
        windows = F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("s"), i.alias("i"))))
        none = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("int").alias("i"))
        sided = _let(windows, lambda s: F.arrays_zip(s.alias("own"), F.concat(F.array(none), F.slice(s, F.lit(1), F.size(s) - 1)).alias("before"), F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(none)).alias("after")))
        twice = F.filter(sided, lambda x: (x["own"]["s"].eqNullSafe(x["before"]["s"])) | (x["own"]["s"].eqNullSafe(x["after"]["s"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["own"]["i"]))
        steps = _let(starts, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(n)), F.lit(n))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    return _let(words, lambda w: F.when(F.size(w) > n, of_windows(w)).otherwise(F.lit(0).cast("long")))


def dup_lines(text: Column) -> Column:
    """How many lines with a word are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text (null: none)."""
    body = F.col("_text")
    cut = docs.select(*keep, F.col(text).alias("_text"))
    return cut.select(
        *keep,
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.length(body) - F.length(F.translate(body, "#*$%&|<>", "")), F.lit(0)).cast("long").alias("n_symbols"),
        dup_lines(body).alias("n_dup_lines"),
        repeat_words(words_of(body)).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_measures(measured: DataFrame) -> DataFrame:
    """Adds the measures as whole thousandths; 0 for texts without words."""
    per_word = lambda c, scale=1000: F.when(F.col("n_words") > 0, F.floor(F.col(c) * scale / F.col("n_words"))).otherwise(0).cast("long")
    return measured.withColumns({"symbols": per_word("n_symbols"), "repeats": per_word("n_repeat_words"), "dup_lines": per_word("n_dup_lines", 10_000), "word_length": per_word("word_chars")})


def bucket(x: Column) -> Column:
    """The sketch's bucket as the least value in it."""
    shift = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return F.when(x < 32, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)).cast("long")


def sketch(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(by..., measure, bucket, number)`` over the rows of ``measured``."""
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES)))
    return measured.select(*by, named.alias("x")).groupBy(*by, "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("number"))


def merge(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sketches of coarser cells, from those of finer ones."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("number").alias("number"))


def quartiles(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(by..., measure, n, q1, q3)``; a quantile is the bucket with the row of that rank."""
    cell = W.partitionBy(*by, "measure")
    upto = F.sum("number").over(cell.orderBy("bucket"))
    ranked = sketches.withColumns({"n": F.sum("number").over(cell), "upto": upto})
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketches: DataFrame) -> DataFrame:
    """``(lang, source, <measure>_low, <measure>_high...)``, a row for each cell of the sketches."""
    levels = [("lang", "source"), ("lang",), ()]
    at = [quartiles(sketches if k == 0 else merge(sketches, by), by) for k, by in enumerate(levels)]
    own, lang, every = (d.select(*(F.col(c).alias(f"{c}_{k}") for c in by), F.col("measure").alias(f"m{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("n", "q1", "q3"))) for k, (d, by) in enumerate(zip(at, levels, strict=True)))
    joined = own.join(lang, F.col("lang_0").eqNullSafe(F.col("lang_1")) & (F.col("m0") == F.col("m1"))).join(every, F.col("m0") == F.col("m2"))
    pick = lambda c: F.when(F.col("n0") >= SUPPORT, F.col(f"{c}0")).when(F.col("n1") >= SUPPORT, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    q1, q3 = pick("q1"), pick("q3")
    least = F.element_at(F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair)), F.col("m0"))
    width = F.greatest(q3 - q1, least) * FENCE
    bounds = joined.select(F.col("lang_0").alias("lang"), F.col("source_0").alias("source"), "m0", (q1 - width).alias("low"), (q3 + width).alias("high"))
    one = lambda m, c: F.max(F.when(F.col("m0") == m, F.col(c))).alias(f"{m}_{c}")
    return bounds.groupBy("lang", "source").agg(*(one(m, c) for m in MEASURES for c in ("low", "high")))


def quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``, a row for each row of ``docs``.

    Null languages and sources are cells as any other. Texts that the fixed rules fail take no part in the sketches. Null and empty texts have no words, which the fixed rules
    fail. A very long text is measured whole; its words are held as one array, and windows are only sorted where a hash repeats. Rows that tie at a fence are kept; repeated rows, and rows
    without ids, are judged each by itself and all count in the sketches. Columns but id, text, lang and source are not read, whatever their names; an empty table gives an empty one.
    """
    measured = measure(docs.select(F.col(id_col).alias("_id"), F.col("lang"), F.col("source"), F.col(text).alias("_body")), "_body", ("_id", "lang", "source"))
    measured = materialize(with_measures(measured).withColumn("base_failed", base_failed()), "quality-measures")
    bounds = fences(sketch(measured.where("not base_failed"))).select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(f"{m}_{c}" for m in MEASURES for c in ("low", "high")))
    joined = measured.join(bounds, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    usual = F.lit(True)
    for m in MEASURES:
        usual = usual & (F.col(m) <= F.col(f"{m}_high"))
        if m in TWO_SIDED:
            usual = usual & (F.col(m) >= F.col(f"{m}_low"))
    kept = ~F.col("base_failed") & F.coalesce(usual, F.lit(False))
    return joined.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
