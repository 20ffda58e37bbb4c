"""Preference formatting of conversations (operator 7), by DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text) is rendered once as the prompt;
what follows in each is rendered as a completion, with a mask: the code-point ranges that the assistant wrote, on
which alone a loss is to be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: opening, what stands between role and text, closing (the closing is learnt with an assistant's text).
OPEN, BETWEEN, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BETWEEN))


def _tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of what the assistant wrote in ``render(turns)``, joined by commas; code points, end exclusive.

    Starts are running sums, kept with the array they build as it is folded. Neighbouring ranges never touch: an opening stands between them.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("ranges"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(_head(t))
        end = begin + F.length(_tail(t))
        range_ = F.concat(F.when(a["ranges"] != "", F.lit(",")).otherwise(F.lit("")), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.concat(a["ranges"], F.when(t["role"] == "assistant", range_).otherwise(F.lit(""))).alias("ranges"))

    return F.aggregate(turns, start, step, lambda a: a["ranges"])


def preference_pairs(conversations: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """``(pair_id, n_common, n_chosen, n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask)``.

    ``pair`` gives each turn's pair (turns of none: null), ``chosen`` whether it belongs to the pair's chosen
    conversation. Turns are ordered by ``turn``, ties by role and text, nulls first; a null role or text renders as
    nothing. Pairs of which a side has no turn are left out, as there is nothing to prefer. One shuffle brings a
    pair's turns together: they are the row that is returned, so a very long conversation takes the memory of its own row several times over. Repeated turns stay,
    as turns that tie. Columns but turn, role, text and what ``pair`` and ``chosen`` use are not read, whatever their names; an empty table gives an empty one.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = conversations.select(pair.alias("pair_id"), chosen.alias("_chosen"), turn.alias("_turn")).where(F.col("pair_id").isNotNull() & F.col("_chosen").isNotNull())
    both = sides.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("_chosen") == is_chosen, F.col("_turn")))).alias(name) for name, is_chosen in (("c", True), ("r", False))))
    both = both.where((F.size("c") > 0) & (F.size("r") > 0))
    content = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = both.select("pair_id", content(F.col("c")).alias("c"), content(F.col("r")).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, F.lit(False))
    both = both.withColumn("n_common", F.when(first_other == 0, F.size("c")).otherwise(first_other - 1).cast("long"))
    rest = lambda side: F.slice(F.col(side), (F.col("n_common") + 1).cast("int"), F.size(side))
    return both.select(
        "pair_id", "n_common", F.size("c").cast("long").alias("n_chosen"), F.size("r").cast("long").alias("n_rejected"),
        render(F.slice("c", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"), render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"), mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"),
    )
