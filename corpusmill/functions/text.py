"""Text helpers whose results do not depend on the engine's locale or whitespace rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.constants import REASONING_CLOSE

# Words (letters, marks, digits, underscore) or single symbols; separators of any script split.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN)).cast("bigint")


def adjacent_pairs(items: Column, ended: bool = False) -> Column:
    """``[a, b, c]`` -> ``[(a, b), (b, c)]`` as structs ``prev, cur``, in linear time.

    With ``ended`` the last item follows as ``(c, null)``.
    """
    n = F.greatest(F.size(items) - 1, F.lit(0))
    first = items if ended else F.slice(items, F.lit(1), n)
    zipped = F.arrays_zip(first.alias("prev"), F.slice(items, F.lit(2), n).alias("cur"))
    return zipped.cast("array<struct<prev:string,cur:string>>")


def letters_only(text: Column) -> Column:
    """Lower-cased letters, with every run of anything else as one space."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", " "))


def trigrams(letters: Column) -> Column:
    """Overlapping three-character windows.

    The lookahead yields all windows in one linear pass; ``substring`` per position would walk
    the string from its start each time.
    """
    return F.regexp_extract_all(letters, F.lit(r"(?=([ \p{L}]{3}))"), F.lit(1))


def overlapping_slices(text: Column, size: int, overlap: int) -> Column:
    """The text in slices of ``size`` characters, each with the first ``overlap`` of the next.

    Every window of ``overlap + 1`` characters lies in exactly one slice, so windows of a very long
    text can be taken slice by slice instead of as one huge array.
    """
    last = F.floor((F.char_length(text) - 1) / F.lit(size)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda k: F.substring(text, k * size + 1, F.lit(size + overlap)),
    )
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(cut)


def strip_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"^\n+|\n+\z", "")


def reasoning_content(text: Column) -> Column:
    """What follows the last closing marker; the whole text when there is none."""
    return strip_newlines(F.substring_index(text, REASONING_CLOSE, -1))


def reasoning_thinking(text: Column) -> Column:
    """What precedes the last closing marker, without the marker; empty when there is none."""
    tail = F.char_length(F.substring_index(text, REASONING_CLOSE, -1))
    head = F.char_length(text) - tail - F.lit(len(REASONING_CLOSE))
    return F.when(head < 0, F.lit("")).otherwise(
        strip_newlines(F.substring(text, F.lit(1), F.greatest(head, F.lit(0))))
    )
