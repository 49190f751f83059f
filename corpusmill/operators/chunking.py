"""Cutting documents at Markdown separators."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.constants import MARKDOWN_SEPARATORS


def _cut_before(text: Column, separator: str) -> Column:
    """The text cut before each match of ``separator``, so the pieces add up to the text."""
    matches = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(separator), F.lit(0)))
    return F.zip_with(matches, F.split(text, separator, -1), lambda m, rest: F.concat(m, rest))


def _every(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.char_length(text) - 1) / F.lit(size)).cast("int"))
    return F.transform(starts, lambda k: F.substring(text, k * size + 1, F.lit(size)))


def pieces(text: Column, size: int) -> Column:
    """Pieces of at most ``size`` characters that add up to the text; none for null or no text.

    The separators are tried from the strongest to the weakest, each on the pieces that are still
    too long; a separator stays at the front of its piece. What no separator cuts is cut every
    ``size`` characters.
    """
    whole = F.coalesce(text, F.lit(""))
    found = F.filter(F.array(whole), lambda p: p != "")
    for separator in [s for s in MARKDOWN_SEPARATORS if s]:
        found = _shorter(found, size, partial(_cut_before, separator=separator))
    return _shorter(found, size, partial(_every, size=size))


def _shorter(found: Column, size: int, cut: Callable[[Column], Column]) -> Column:
    """The pieces, those of more than ``size`` characters cut and without empty ones."""

    def parts(piece: Column) -> Column:
        return F.when(F.char_length(piece) > size, F.filter(cut(piece), lambda q: q != "")).otherwise(
            F.array(piece)
        )

    return F.flatten(F.transform(found, parts))


def chunk_documents(df: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """(keys, chunk, text): consecutive pieces put together, never more than ``size`` characters.

    The text is thought of in stretches of ``size`` characters. Pieces that lie within one stretch
    are one chunk, and a piece that lies across the end of a stretch is a chunk of its own, so a
    chunk follows from the running length alone. Chunks count up in the order of the text, with
    gaps. The running length and the gathering share one shuffle by document.
    """
    long = df.select(*keys, F.posexplode(pieces(F.col(text), size)).alias("pos", "piece"))
    earlier = (
        Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.char_length("piece")).over(earlier), F.lit(0))
    first = F.floor(F.col("start") / F.lit(size))
    last = F.floor((F.col("start") + F.char_length("piece") - 1) / F.lit(size))
    placed = long.withColumn("start", start).withColumn("chunk", first + last)
    gathered = placed.groupBy(*keys, "chunk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("_pieces")
    )
    joined = F.array_join(F.transform("_pieces", lambda p: p["piece"]), "")
    return gathered.select(*keys, "chunk", joined.alias("text"))


MANY = 512  # chunk starts that are kept in one list of a growing list of lists


def _greedy_starts(lengths: Column, size: int) -> Column:
    """Places of the pieces that begin a chunk: a piece goes to the chunk before it if it still fits.

    One fold over the lengths. Starts are gathered in lists of ``MANY``, so that adding one to a long
    document's copies no long list.
    """
    nothing = F.array().cast("array<int>")
    begin = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("used"),
        nothing.alias("starts"),
        F.array().cast("array<array<int>>").alias("done"),
    )

    def step(state: Column, length: Column) -> Column:
        opens = (state["at"] == 0) | (state["used"] + length > size)
        full = opens & (F.size(state["starts"]) >= MANY)
        starts = F.when(full, nothing).otherwise(state["starts"])
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(opens, length).otherwise(state["used"] + length).alias("used"),
            F.when(opens, F.concat(starts, F.array(state["at"]))).otherwise(starts).alias("starts"),
            F.when(full, F.concat(state["done"], F.array(state["starts"]))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(
        lengths, begin, step, lambda state: F.flatten(F.concat(state["done"], F.array(state["starts"])))
    )


def chunk_greedily(df: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """(keys, chunk, text): consecutive pieces put together as long as they fit into ``size`` characters.

    Chunks count up from 0 without gaps and add up to the text; a null or empty text has none. All of it
    is done where the document lies, without a shuffle.
    """
    cut = df.select(*keys, pieces(F.col(text), size).alias("_pieces"))
    lengths = F.transform("_pieces", lambda p: F.char_length(p))
    cut = cut.withColumn("_starts", _greedy_starts(lengths, size))
    ends = F.concat(F.slice("_starts", 2, F.size("_starts")), F.array(F.size("_pieces")))
    spans = F.filter(F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b")), lambda s: s["b"] > s["a"])
    joined = F.transform(spans, lambda s: F.array_join(F.slice("_pieces", s["a"] + 1, s["b"] - s["a"]), ""))
    return cut.select(*keys, F.posexplode(joined).alias("chunk", "text"))
