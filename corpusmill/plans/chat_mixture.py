"""Building a chat mixture: cheap filters, one-pass mapping to subsets, language last."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.langid import LanguageModel, only_language, train
from corpusmill.operators.mixture import (
    concat,
    exclude_sources,
    has_two_messages,
    map_sources,
    not_excluded,
)
from corpusmill.plans.recipe import open_entry
from corpusmill.session import stage


def build_mixture(
    mixture: DataFrame,
    source_map: dict[str, str],
    exclude: list[str],
    local: DataFrame | None = None,
    local_subset: str = "local",
    english: LanguageModel | None = None,
) -> DataFrame:
    """(id, messages, source, config): filtered and mapped, plus an unfiltered local table.

    Rows of unmapped sources, and of a null source, are dropped by the mapping. Language is judged
    last, only for what the cheap steps leave.
    """
    chats = mixture.select("id", "messages", "source")
    kept = exclude_sources(chats, exclude).where(has_two_messages(F.col("messages")))
    mapped = map_sources(kept, source_map).select("id", "messages", "source", "config")
    if english is not None:
        # Staged, so that the mixture is scanned once though it is judged and then filtered.
        mapped = only_language(stage(mapped, "mapped"), english)
    if local is None:
        return mapped
    return concat([mapped, local.withColumn("config", F.lit(local_subset))])


def build_mixture_from(
    spark: SparkSession, recipe: dict[str, Any], labelled: DataFrame | None = None
) -> DataFrame:
    """The mixture a recipe describes, with ``split``.

    The first entry is the mixture; a second, if given, is the local table. ``only_english`` needs
    ``labelled``, a table (lang, text) to learn the languages from.
    """
    mixture, *others = recipe["datasets"]
    english = None
    if recipe.get("only_english", False):
        if labelled is None:
            raise ValueError("only_english needs a table of labelled text")
        english = train(labelled)
    built = build_mixture(
        open_entry(spark, mixture),
        mixture["source_map"],
        mixture.get("exclude", []),
        open_entry(spark, others[0]).select("id", "messages", "source") if others else None,
        others[0].get("subset", others[0]["name"]) if others else "local",
        english,
    )
    return built.withColumn("split", F.lit(mixture.get("split", "train")))


def funnel_stages(exclude: list[str], source_map: dict[str, str], english: Column | None = None):
    """The filter stages over per-conversation rows with ``source`` and ``n_messages``.

    ``english`` says whether every message of the conversation is; without it that stage is left out.
    """
    stages = [
        ("not_excluded", not_excluded(F.col("source"), exclude)),
        ("two_messages", F.col("n_messages") == 2),
    ]
    if english is not None:
        stages.append(("english", english))
    return [*stages, ("mapped", F.col("source").isin(list(source_map)))]
