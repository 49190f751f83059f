"""From a chat table to training text: shuffle, take N, render, split."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import chat
from corpusmill.functions.constants import SEED, TEST_FRACTION
from corpusmill.operators.columns import clean_preferences
from corpusmill.operators.mixture import concat
from corpusmill.operators.sampling import exact_split, sample_n, split_label
from corpusmill.plans.recipe import open_entry, weighed
from corpusmill.schemas import PREFERENCES_RAW
from corpusmill.sources.tables import scan_json_array


def build_training_text(
    chats: DataFrame,
    keys: list[str],
    eos: str,
    samples: int | None = None,
    test_fraction: float = TEST_FRACTION,
    seed: int = SEED,
    exact: bool = False,
) -> DataFrame:
    """(keys, text, split). The split seed differs from the shuffle seed so the two are unrelated.

    ``exact`` fixes the number of test rows; otherwise each row is decided by its own key.
    """
    taken = chats if samples is None else sample_n(chats, samples, keys, seed, "_place")
    rendered = taken.select(*keys, chat.sft_text(F.col("messages"), eos).alias("text"))
    split_seed = f"split-{seed}"
    if exact:
        return exact_split(rendered, keys, test_fraction, split_seed)
    return rendered.withColumn("split", split_label(keys, test_fraction, split_seed))


def build_training_text_from(
    spark: SparkSession, recipe: dict[str, Any], keys: list[str], eos: str
) -> DataFrame:
    """Training text of every dataset entry, each shuffled and cut to its own ``samples``."""
    seed = recipe.get("seed", SEED)
    fraction = recipe.get("test_fraction", TEST_FRACTION)
    parts = [
        build_training_text(
            open_entry(spark, entry), keys, eos, entry.get("samples"), fraction, seed
        ).withColumn("config", F.lit(entry.get("subset", entry["name"])))
        for entry in recipe["datasets"]
    ]
    return weighed(concat(parts), recipe, keys)


def build_chats_from_json(spark: SparkSession, recipe: dict[str, Any]) -> DataFrame:
    """(id, messages, source, config, split) from every entry's files of question rows as JSON."""
    parts = []
    for entry in recipe["datasets"]:
        name = entry.get("subset", entry["name"])
        raw = scan_json_array(spark, entry["path"], PREFERENCES_RAW)
        chats = questions_to_chat(raw, name)
        parts.append(
            chats.withColumn("config", F.lit(name)).withColumn("split", F.lit(entry.get("split", "train")))
        )
    return weighed(concat(parts), recipe, ["id"])


def questions_to_chat(raw: DataFrame, source: str) -> DataFrame:
    """Dirty question/answer rows -> chat rows with an id built from course and question."""
    clean = clean_preferences(raw)
    number = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("course_id", "question_id")]
    return clean.select(
        F.concat_ws("_", F.lit(source), *number).alias("id"),
        chat.question_answer(F.col("question_body"), F.col("question_answer")).alias("messages"),
        F.lit(source).alias("source"),
    )
