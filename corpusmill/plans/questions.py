"""Building the multiple-choice corpus and its prompts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import mcqa
from corpusmill.functions.constants import SEED, STEM_SUBJECTS
from corpusmill.operators.adapters import POSITION, Origin, adapt_all
from corpusmill.operators.mixture import concat
from corpusmill.operators.ordering import hash_position
from corpusmill.operators.tokens import batches
from corpusmill.plans.recipe import open_entry
from corpusmill.sources.tables import with_row_position


def build_questions(spark: SparkSession, recipe: dict[str, Any]) -> DataFrame:
    """Canonical rows of every entry with ``config`` and ``split``; positions come from the scan."""
    general = recipe.get("general", {})
    inputs = []
    for entry in recipe["datasets"]:
        origin = Origin(
            entry["name"],
            entry.get("subset", entry["name"]),
            entry.get("split", "train"),
            general.get("stem_subjects", STEM_SUBJECTS),
            recipe.get("seed", SEED),
        )
        inputs.append((with_row_position(open_entry(spark, entry), POSITION), origin))
    return adapt_all(inputs)


def prompt_batches(
    questions: DataFrame, size: int, keys: tuple[str, ...] = ("id",), seed: int = SEED
) -> DataFrame:
    """Questions shuffled, turned into prompts and collated: one row of parallel lists per batch."""
    placed = hash_position(questions, seed, list(keys), "_place")
    columns = ["prompt", "options", "correct_idx", "dataset"]
    return batches(prompts(placed, "_place"), "_place", columns, size)


def build_question_sets(spark: SparkSession, recipe: dict[str, Any]) -> DataFrame:
    """Batches of prompts for training and for validation, told apart by ``set``.

    The entries of each ``use`` (train by default) are joined, shuffled by seed, turned into prompts
    and collated, each set by itself.
    """
    seed = recipe.get("seed", SEED)
    sets = []
    for use in ("train", "validation"):
        entries = [e for e in recipe["datasets"] if e.get("use", "train") == use]
        if entries:
            questions = build_questions(spark, recipe | {"datasets": entries})
            made = prompt_batches(questions, recipe.get("batch_size", 8), ("config", "split", "id"), seed)
            sets.append(made.withColumn("set", F.lit(use)))
    return concat(sets)


def prompts(questions: DataFrame, *carry: str) -> DataFrame:
    """Prompt rows; ``valid`` says whether the answer points at one of the choices."""
    index = mcqa.answer_index(F.col("answer"))
    return questions.select(
        *carry,
        mcqa.prompt(F.col("question"), F.col("choices")).alias("prompt"),
        mcqa.option_letters(F.col("choices")).alias("options"),
        index.alias("correct_idx"),
        "dataset",
        mcqa.answer_valid(index, F.col("choices")).alias("valid"),
    )
