"""Expressions for multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.constants import CHOICE_PATTERN, MAX_LETTERS, MCQA_HEADER
from corpusmill.functions.hashing import seeded_md5
from corpusmill.functions.text import strip


def letter_at(index: Column, count: int = 4) -> Column:
    """0 -> 'A', 1 -> 'B', ...; an index outside ``0..count-1`` gives null, never a wrap."""
    inside = index.between(0, count - 1)
    return F.when(inside, F.char(index + F.lit(ord("A"))))


def upper_letter(letter: Column, count: int = 5) -> Column:
    """'a' -> 'A' for the first ``count`` letters, else null."""
    allowed = [chr(ord("a") + i) for i in range(count)]
    return F.when(letter.isin(allowed), F.upper(letter))


def answer_index(answer: Column) -> Column:
    """Letter -> 0-based index after trimming and upper-casing; null for anything but one letter
    or digit-like character. Numeric keys come out negative and are flagged by ``answer_valid``."""
    cleaned = F.upper(strip(answer))
    return F.when(F.char_length(cleaned) == 1, F.ascii(cleaned) - F.lit(ord("A")))


def answer_valid(index: Column, choices: Column) -> Column:
    """Whether the index points at one of the choices."""
    return F.coalesce((index >= 0) & (index < F.size(choices)), F.lit(False))


def option_letters(choices: Column) -> Column:
    """' A', ' B', ... one per choice, 26 at most."""
    n = F.least(F.size(choices), F.lit(MAX_LETTERS))
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.concat(F.lit(" "), F.char(i + F.lit(ord("A")))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def prompt(question: Column, choices: Column) -> Column:
    """Header, question, lettered choices and the answer cue."""
    lines = F.transform(
        F.slice(choices, 1, MAX_LETTERS),
        lambda c, i: F.concat(
            F.char(i + F.lit(ord("A"))), F.lit(". "), F.coalesce(c, F.lit("")), F.lit("\n")
        ),
    )
    return F.concat(
        F.lit(MCQA_HEADER),
        F.coalesce(question, F.lit("")),
        F.lit("\n"),
        F.array_join(lines, ""),
        F.lit("Answer:"),
    )


def packed_choices(options: Column) -> Column:
    """``"a ) x , b ) y"`` -> ``["x", "y"]``. A comma ends a choice, also inside a number."""
    found = F.regexp_extract_all(options, F.lit(CHOICE_PATTERN), F.lit(1))
    return F.transform(found, lambda c: F.replace(strip(c), F.lit(" ."), F.lit(".")))


def shuffled(choices: Column, seed: int, key: Column) -> Column:
    """Choices in an order drawn from the seed, the row key and the choice's place."""
    ranked = F.transform(
        choices,
        lambda c, i: F.struct(
            seeded_md5(seed, key, i).alias("h"), i.alias("i"), c.alias("choice")
        ),
    )
    return F.transform(F.array_sort(ranked), lambda r: r["choice"])


def first_index(choices: Column, value: Column) -> Column:
    """0-based place of the first equal choice; null when absent."""
    at = F.array_position(choices, value)
    return F.when(at > 0, at - 1)
