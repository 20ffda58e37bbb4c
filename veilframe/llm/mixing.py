"""Mixing sources to target weights by subset-sum budget fitting (operator 1).

Every source gets a word budget from its weight, at most ``cap`` times its own size; budgets that the cap cuts are
shared again by weight (water filling). A budget is met in whole passes over the source, and a rest. The rest is a
subset-sum problem over the *counts of documents by exact length*, not over documents: most of it goes to all
lengths in proportion, the remaining budget (a few of the longest documents) is fitted by bounded-knapsack dynamic
programming, which mostly hits it exactly. Then each length's quota of documents is drawn by seeded hashes.

What is gathered by source is the histogram of lengths, which has at most as many rows as the longest document has
words. Drawing ranks rows by (source, length, bucket of hashes), so that a length which a third of all rows
share is still many small groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.llm.shared import WORD, materialize, ship

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
#: Rows that a bucket of hashes is meant to hold.
BUCKET = 512


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, a row a source.

    Sources by code point, null last, take the weights in turn. Water filling in one pass: by rising
    ratio of limit to weight, source after source is full while the level that the rest would get is above its ratio.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    cyclic = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    known = sizes.select("source", F.col("source_size").cast("long").alias("source_size")).withColumn("w", cyclic)
    known = known.withColumn("limit", F.col("source_size") * float(cap))
    rising = W.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    until, whole = rising.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(until), F.lit(0.0)))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(until), F.lit(0.0)))
    ratio = F.col("limit") / F.col("w")
    staged = known.withColumn("level", F.when(level < ratio, level))
    # the first source that is not full sets the level for all after it
    final = F.first("level", ignorenulls=True).over(W.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return staged.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (ratio <= F.col("final")), F.col("limit")).otherwise(F.col("w") * F.col("final")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget`` or as near as can be.

    Proportional quotas first, up to a rest of two of the longest documents; a greedy pass from the longest length down for what rounding left; then
    bounded-knapsack dynamic programming on that rest. Lengths are distinct; zero lengths are never taken. Every
    length takes part, however long.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    reach = 2 * int(lengths.max())
    # integer arithmetic on Python numbers: counts times budget may pass 64 bits
    spread = max(budget - reach, 0)
    taken = np.array([int(c) * spread // total if n else 0 for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)], np.int64)
    rest = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if rest <= reach or n == 0:
            break
        more = min(int(counts[i] - taken[i]), -(-(rest - reach) // n), rest // n)
        taken[i] += more
        rest -= more * n
    # from a proportional start every length has documents left, so short ones are there for the fine fit
    return taken + _knapsack(lengths, np.where(lengths > 0, counts - taken, 0), rest)


def _knapsack(lengths: np.ndarray, free: np.ndarray, rest: int) -> np.ndarray:
    """The multiset within ``free`` whose sum is nearest to ``rest`` (below wins ties).

    Lengths are divided by their greatest common divisor and counts split into powers of two. Reachable sums are the bits of one long
    integer; the item that first reaches a sum is kept, and by following it a sum is taken apart again. It ends as soon
    as no sum can be nearer. Taking nothing misses by ``rest``, so no sum of twice that or more matters: the table takes 4 bytes for each step of the
    divisor up to ``rest`` and the longest length, or twice ``rest`` if that is less.
    """
    usable = np.flatnonzero((free > 0) & (lengths < 2 * rest))
    if not len(usable):
        return np.zeros(len(lengths), np.int64)
    step = int(np.gcd.reduce(lengths[usable]))
    goal = (2 * rest + step - 1) // (2 * step)  # the step nearest to the rest, the lower one of two
    size = min(rest // step + int(lengths[usable].max()) // step, 2 * rest // step) + 1
    mask, bits = (1 << size) - 1, 1
    first = np.full(size, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in usable[np.argsort(-lengths[usable], kind="stable")].tolist():
        n, left, k = int(lengths[i]) // step, int(free[i]), 1
        while left and n * k < size:
            k = min(k, left)
            new = ((bits << (n * k)) & mask) & ~bits
            if new:
                raw = np.frombuffer(new.to_bytes(size // 8 + 1, "little"), np.uint8)
                held = np.flatnonzero(raw)
                which = np.unpackbits(raw[held, None], axis=1, bitorder="little")
                row, bit = np.nonzero(which)
                first[held[row] * 8 + bit] = len(items)
                items.append((i, k))
                bits |= new
            left -= k
            k *= 2
        if bits >> goal & 1:
            break
    sums = np.flatnonzero(np.concatenate(([True], first[1:] >= 0)))
    at = int(sums[np.lexsort((sums, np.abs(sums * step - rest)))[0]])
    taken = np.zeros(len(lengths), np.int64)
    while at:
        i, k = items[first[at]]
        taken[i] += k
        at -= int(lengths[i]) // step * k
    return taken


def quotas(histogram: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """``(source, size, number, passes, extra, source_size, target)``: each length's whole passes and drawn documents."""
    ship(histogram.sparkSession)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from veilframe.llm.mixing import fit_budget as solve

        pdf = pdf.sort_values("size", ignore_index=True)
        goal, whole = round(float(pdf["target"].iloc[0])), int(pdf["source_size"].iloc[0])
        passes = min(goal // whole, cap) if whole else 0
        extra = solve(pdf["size"].to_numpy(np.int64), pdf["number"].to_numpy(np.int64), goal - passes * whole if passes < cap else 0)
        return pdf.assign(passes=(pdf["size"] > 0) * passes, extra=extra)  # texts without words are never taken

    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    g = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    both = histogram.join(g, F.col("source").eqNullSafe(F.col("g_source"))).select("source", "size", "number", "source_size", "target")
    return both.withColumn("_s", named).groupBy("_s").applyInPandas(lambda pdf: fit(pdf[["source", "size", "number", "source_size", "target"]]), "source string, size long, number long, source_size long, target double, passes long, extra long")


def _drawn(docs: DataFrame, text: str, id_col: str, source: str, weights: Sequence[float], cap: int, seed: int) -> DataFrame:
    """``(_id, _text, source, size, source_size, target, copies)``, a row for each row of ``docs``; ``_text`` is the text's hash."""
    sized = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sized = materialize(sized, "mix-sizes")
    histogram = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("number")), "mix-histogram")
    goals = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("number")).alias("source_size")), weights, cap)
    plan = materialize(quotas(histogram, goals, cap), "mix-quotas").withColumn("buckets", F.ceil(F.col("number") / BUCKET))
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "number", "passes", "extra", "source_size", "target", "buckets")
    drawn = sized.join(p, sized["source"].eqNullSafe(F.col("p_source")) & (sized["size"] == F.col("p_size"))).drop("p_source", "p_size")
    # the text's hash keeps rows apart that have no id
    drawn = drawn.withColumn("_hash", F.xxhash64(F.coalesce("_id", F.lit(-1)), "_text", F.lit(seed))).withColumn("_bucket", F.pmod("_hash", F.col("buckets")))
    drawn = materialize(drawn, "mix-drawn")
    result = ("_id", "_text", "source", "size", "source_size", "target", "copies")
    settled = drawn.where("extra = 0 or extra = number").withColumn("copies", F.col("passes") + (F.col("extra") > 0).cast("long"))
    open_ = drawn.where("extra > 0 and extra < number")
    small = open_.where("buckets = 1").withColumn("_before", F.lit(0).cast("long"))
    large = open_.where("buckets > 1")
    filled = large.groupBy("source", "size", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    filled = filled.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("_bucket").alias("b_bucket"), before.alias("_before"))
    large = large.join(filled, large["source"].eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("_bucket") == F.col("b_bucket"))).drop("b_source", "b_size", "b_bucket")
    rank = F.row_number().over(W.partitionBy("source", "size", "_bucket").orderBy("_hash", "_id", "_text"))
    ranked = small.unionByName(large).withColumn("copies", F.col("passes") + (rank + F.col("_before") <= F.col("extra")).cast("long"))
    return settled.select(*result).unionByName(ranked.select(*result))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken)``, a row for each row of ``docs``.

    ``copies`` (0 to ``cap``) is how often the mix takes the row, ``taken`` its words. Null and empty texts have size 0 and
    are never drawn; of very long texts only the length counts. Rows that repeat count each. Ties of hashes go by id, then by text, so a rerun
    on the same rows takes the same copies. Other columns of ``docs`` are not read, whatever their names; an empty table gives an empty one.
    """
    every = _drawn(docs, text, id_col, source, weights, cap, seed)
    return every.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as the mix takes it."""
    chosen = _drawn(docs, text, id_col, source, weights, cap, seed)

    def key(id_: Column, source_: Column, text_hash: Column) -> Column:
        """One join key of what tells rows apart for the mix, so that the texts are shuffled once, for join and window."""
        return F.sha2(F.concat_ws("\x00", *(F.coalesce(c.cast("string"), F.lit("\x01")) for c in (id_, source_, text_hash))), 256)

    # rows that share id, source and text share a key: how many of them are taken once, twice and so on is dealt out by a running number
    times = [F.count_if(F.col("copies") >= k).alias(f"__mix_{k}") for k in range(1, cap + 1)]
    c = chosen.groupBy(key(F.col("_id"), F.col("source"), F.col("_text")).alias("__mix_key")).agg(*times)
    c = materialize(c.where("__mix_1 > 0"), "mix-copies")
    keyed = docs.withColumn("__mix_key", key(F.col(id_col), F.col(source), F.xxhash64(F.col(text)))).join(c, "__mix_key")
    number = F.row_number().over(W.partitionBy("__mix_key").orderBy("__mix_1"))
    due = sum((number <= F.col(f"__mix_{k}")).cast("long") for k in range(1, cap + 1))
    taken = keyed.withColumn("__mix_times", due).where("__mix_times > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_times")))
    return taken.select(*docs.columns)
