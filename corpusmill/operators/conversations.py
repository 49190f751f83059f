"""Conversations stored as one row per turn: (conversation, turn, role, content).

Counting, filtering and two-message assembly use aggregates of numbers that combine map-side; texts
are only gathered for the messages that are kept. ``assemble`` and ``sft_text`` build one value per
conversation, which is one row and has to fit into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.chat import sft_piece
from corpusmill.functions.text import strip
from corpusmill.operators.skew import null_safe


def lengths(turns: DataFrame, keys: list[str]) -> DataFrame:
    return turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_messages"))


def two_message(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Conversations of exactly two messages with both of them.

    The keys are counted first; only the messages of conversations of two are gathered, two by two.
    """
    pairs = lengths(turns, keys).where("n_messages = 2").select(*keys)
    kept = null_safe(turns, pairs, keys, "left_semi")
    both = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    message = F.transform(
        F.col("_both"), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    return kept.groupBy(*keys).agg(both.alias("_both")).select(*keys, message.alias("messages"))


def first_contents(turns: DataFrame, keys: list[str], roles: dict[str, str | None]) -> DataFrame:
    """The first content per conversation of each role, '' when there is none.

    ``roles`` maps output column to role; ``None`` takes the first turn whatever its role, and
    leaves it null when it has no content. The first turns' numbers are found first, and only those
    turns' contents are gathered; of several contents of one turn the smallest counts.
    """
    of_role = {
        name: F.lit(True) if role is None else F.coalesce(F.col("role") == role, F.lit(False))
        for name, role in roles.items()
    }
    firsts = turns.groupBy(*keys).agg(
        *[F.min(F.when(own, F.col("turn"))).alias(f"_turn_{name}") for name, own in of_role.items()]
    )
    rows = null_safe(turns.select(*keys, "turn", "role", "content"), firsts, keys)
    hits = {name: own & (F.col("turn") == F.col(f"_turn_{name}")) for name, own in of_role.items()}
    some = F.coalesce(F.greatest(*hits.values(), F.lit(False)), F.lit(False))
    gathered = null_safe(
        firsts.select(*keys),
        rows.where(some)
        .groupBy(*keys)
        .agg(*[F.collect_list(F.when(hit, F.struct("content"))).alias(n) for n, hit in hits.items()]),
        keys,
        "left",
    )
    columns = []
    for name, role in roles.items():
        first = F.get(F.sort_array(F.col(name)), F.lit(0))["content"]
        columns.append((first if role is None else F.coalesce(first, F.lit(""))).alias(name))
    return gathered.select(*keys, *columns)


def assemble(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per conversation with its messages in turn order."""

    def messages(ordered: Column) -> Column:
        return F.transform(
            ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
        )

    return _in_order(turns.select(*keys, "turn", "role", "content"), keys, "messages", messages)


def sft_text(
    turns: DataFrame, keys: list[str], eos: str, skip_other_roles: bool = False
) -> DataFrame:
    """Training text per conversation: turns are rendered where they lie, then joined in order."""
    piece = sft_piece(F.col("role"), F.col("content"), eos, skip_other_roles)
    pieces = turns.select(*keys, "turn", piece.alias("piece"))
    texts = _in_order(
        pieces, keys, "text", lambda t: F.array_join(F.transform(t, lambda p: p["piece"]), "")
    )
    return texts.select(*keys, strip(F.col("text")).alias("text"))


def _in_order(
    rows: DataFrame, keys: list[str], name: str, build: Callable[[Column], Column]
) -> DataFrame:
    """``build`` applied to each conversation's turns in the order of ``turn``, of whatever type."""
    turn = F.struct("turn", *[c for c in rows.columns if c not in keys and c != "turn"])
    return rows.groupBy(*keys).agg(build(F.sort_array(F.collect_list(turn))).alias(name))
