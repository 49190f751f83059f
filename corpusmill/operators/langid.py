"""Language identification from letter trigrams, trained on labelled text.

Log-probabilities are whole numbers (millionths), so sums do not depend on the order of addition
and a score is the same on every cluster. Languages are rows, so there may be any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import letters_only, overlapping_slices, trigrams
from corpusmill.operators.skew import MAX_BROADCAST_BYTES, lookup_join
from corpusmill.session import stage

SCALE = 1_000_000
SLICE = 1 << 16  # characters whose trigrams are held as one array


def log_share(part: Column, whole: Column) -> Column:
    return F.round(F.ln(part.cast("double") / whole.cast("double")) * F.lit(SCALE)).cast("bigint")


def _exploded(df: DataFrame, text: str) -> DataFrame:
    """One row per trigram in ``gram`` in place of ``text``; a text without any keeps a null row.

    ``first`` marks one of the rows of each text.
    """
    others = [c for c in df.columns if c != text]
    plain = df.select(*others, letters_only(F.col(text)).alias("_letters"))
    slices = F.posexplode(overlapping_slices(F.col("_letters"), SLICE, 2)).alias("_part", "_slice")
    grams = F.posexplode_outer(trigrams(F.col("_slice"))).alias("_place", "gram")
    long = plain.select(*others, slices).select(*others, "_part", grams)
    first = (F.col("_part") == 0) & (F.coalesce("_place", F.lit(0)) == 0)
    return long.select(*others, "gram", first.alias("first"))


@dataclass(frozen=True)
class LanguageModel:
    """Trigram counts, staged: (gram, lang, n). The languages with their totals and the number of
    distinct trigrams are plain numbers."""

    counts: DataFrame
    totals: dict[str, int]
    vocabulary: int

    @property
    def languages(self) -> list[str]:
        return sorted(self.totals)

    def _total(self) -> Column:
        return F.create_map(*[F.lit(x) for l in self.languages for x in (l, self.totals[l])])[F.col("lang")]

    def profile(self) -> DataFrame:
        """(lang, gram, n, logp) for the trigrams seen in each language."""
        logp = log_share(F.col("n") + 1, self._total() + self.vocabulary)
        return self.counts.select("lang", "gram", "n", logp.alias("logp"))

    def floors(self) -> Column:
        """Log-probability of an unseen trigram in each language, in the languages' order."""
        return F.array(
            *[log_share(F.lit(1), F.lit(self.totals[l] + self.vocabulary)) for l in self.languages]
        )

    def gains(self) -> DataFrame:
        """(gram, n, gains): for each trigram what it adds to the floor in the languages that have it,
        as (place of the language, gain)."""
        place = (F.array_position(F.array(*[F.lit(l) for l in self.languages]), F.col("lang")) - 1).cast("int")
        more = self.profile().select("gram", "n", "logp", place.alias("place"))
        gain = F.col("logp") - F.get(self.floors(), F.col("place"))
        return more.groupBy("gram").agg(
            F.sum("n").alias("n"), F.collect_list(F.struct("place", gain.alias("gain"))).alias("gains")
        )


def train(
    df: DataFrame, text: str = "text", lang: str = "lang", languages: list[str] | None = None
) -> LanguageModel:
    """Count trigrams by language; rows without a language count for none."""
    texts = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    if languages is not None:
        texts = texts.where(F.col("lang").isin(languages))
    grams = _exploded(texts, "text").where("gram is not null")
    counts = stage(grams.groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n")), "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    for name in languages or []:
        totals.setdefault(name, 0)
    return LanguageModel(counts, totals, counts.select("gram").distinct().count())


def detect(
    df: DataFrame,
    keys: list[str],
    text: str,
    model: LanguageModel,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(keys, n_grams, score, lang) for each row; ``lang`` is null for a text without trigrams.

    Rows are told apart by their keys and text, and equal rows get equal answers, one each. Trigrams
    meet the gains in a broadcast join and are summed where they lie, so what is shuffled is one row
    for each text and language. Ties go to the language that sorts first.
    """
    marked = df.select(*keys, F.xxhash64(text).alias("_mark"), F.col(text).alias("_text"))
    grams = _exploded(marked, "_text")
    found = lookup_join(grams, stage(model.gains(), "gains"), ["gram"], "n", "left", max_broadcast_bytes)
    # Two more sums travel as languages of their own: all trigrams, and the rows themselves.
    entry = "array<struct<place:int,gain:bigint>>"
    some = F.array(F.struct(F.lit(-1).alias("place"), F.lit(1).cast("bigint").alias("gain"))).cast(entry)
    one = F.array(F.struct(F.lit(-2).alias("place"), F.lit(1).cast("bigint").alias("gain"))).cast(entry)
    none = F.array().cast(entry)
    each = F.concat(
        F.coalesce("gains", none),
        F.when(F.col("gram").isNotNull(), some).otherwise(none),
        F.when(F.col("first"), one).otherwise(none),
    )
    sums = (
        found.select(*keys, "_mark", F.inline(each))
        .groupBy(*keys, "_mark", "place")
        .agg(F.sum("gain").alias("gain"))
    )
    texts = sums.groupBy(*keys, "_mark").agg(
        F.max(F.when(F.col("place") == -2, F.col("gain"))).alias("_rows"),
        F.coalesce(F.max(F.when(F.col("place") == -1, F.col("gain"))), F.lit(0)).alias("_grams"),
        F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "gain"))).alias("_gains"),
    )
    texts = texts.withColumn("n_grams", (F.col("_grams") / F.col("_rows")).cast("bigint"))
    names = F.array(*[F.lit(l) for l in model.languages]).cast("array<string>")
    floors = model.floors().cast("array<bigint>")
    # A language without a gain has its floor; of those only the best can win.
    plain = F.transform(
        floors, lambda f, i: F.struct((F.col("n_grams") * f).alias("score"), (-i).alias("rank"))
    )
    gained = F.transform(
        "_gains",
        lambda g: F.struct(
            (F.col("n_grams") * F.get(floors, g["place"]) + (g["gain"] / F.col("_rows")).cast("bigint")).alias("score"),
            (-g["place"]).alias("rank"),
        ),
    )
    best = F.array_max(F.concat(F.array(F.array_max(plain)), gained))
    known = (F.col("n_grams") > 0) & F.lit(bool(model.totals))
    judged = texts.withColumn("_best", best).select(
        *keys,
        "n_grams",
        F.when(known, F.col("_best.score")).alias("score"),
        F.when(known, F.get(names, -F.col("_best.rank"))).alias("lang"),
        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy"),
    )
    return judged.drop("_copy")


def foreign_conversations(
    turns: DataFrame, keys: list[str], turn: str, text: str, model: LanguageModel, wanted: str
) -> DataFrame:
    """Keys of conversations with a message in another language or in none that is known.

    A null key is a conversation as well: join the result null-safe.
    """
    labels = detect(turns, [*keys, turn], text, model)
    return labels.where(~F.col("lang").eqNullSafe(F.lit(wanted))).select(*keys).distinct()


def only_language(df: DataFrame, model: LanguageModel, wanted: str = "en") -> DataFrame:
    """Rows (with a ``messages`` array) whose every message is in ``wanted``.

    Each row is judged by its own messages, whatever its other columns hold; rows with equal messages
    share one judgement. A row without messages passes. ``df`` is read twice.
    """
    content = F.to_json(F.struct(F.col("messages.content").alias("c")))
    judged = df.withColumn("_row", F.sha2(content, 256))
    turns = judged.select("_row", F.posexplode("messages").alias("_turn", "_message")).select(
        "_row", "_turn", F.col("_message.content").alias("_content")
    )
    foreign = foreign_conversations(turns, ["_row"], "_turn", "_content", model, wanted)
    return judged.join(foreign, "_row", "left_anti").drop("_row")
