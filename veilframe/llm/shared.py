"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.sources.scratch import materialize, scratch_dir, ship, spread, table

__all__ = ["ASCII_UPPER", "SPACES", "WORD", "count_words", "lower_ascii", "materialize", "scratch_dir", "ship", "split_words", "spread", "table"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of bytes that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between such words.
SPACES = r"\x20\x09-\x0D"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would fold other alphabets too)."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def split_words(text: Column, separators: str = SPACES) -> Column:
    """The words of a text in order; none for null and for texts without any. ``separators`` is the inside of a character class."""
    return _cut(text, separators, lambda a, first, last: F.slice(a, first + 1, F.size(a) - first - last))


def count_words(text: Column, separators: str = SPACES) -> Column:
    """How many words ``split_words`` gives (long)."""
    return _cut(text, separators, lambda a, first, last: F.size(a) - first - last).cast("long")


def _cut(text: Column, separators: str, of_words) -> Column:  # noqa: ANN001
    """``of_words(pieces, first, last)``: a text cut at runs of separators, and how many pieces to leave out at either end (an empty one, if it begins or ends with some).

    Where the class has many ranges a split takes a fraction of the time of matching words, each character of which is tried against all ranges.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), f"[{separators}]++")

    def each(a: Column) -> Column:
        return of_words(a, (F.get(a, F.lit(0)) == "").cast("int"), ((F.size(a) > 1) & (F.element_at(a, -1) == "")).cast("int"))

    return F.element_at(F.transform(F.array(pieces), each), 1)
