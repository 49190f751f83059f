"""Joining several chat tables into one, each as its own config."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.constants import SEED
from corpusmill.operators.columns import keep, rename
from corpusmill.operators.mixture import concat
from corpusmill.operators.sampling import shuffle
from corpusmill.plans.recipe import open_entry, weighed
from corpusmill.sources.sinks import save, write_splits


def build_corpus(spark: SparkSession, recipe: dict[str, Any]) -> DataFrame:
    """Every entry renamed and projected as it says, tagged by subset and split, concatenated, and
    mixed by weight where the recipe has weights."""
    parts = []
    for entry in recipe["datasets"]:
        df = open_entry(spark, entry)
        if "rename" in entry:
            df = rename(df, entry["rename"])
        if "columns" in entry:
            df = keep(df, entry["columns"])
        tagged = df.withColumn("config", F.lit(entry.get("subset", entry["name"]))).withColumn(
            "split", F.lit(entry.get("split", "train"))
        )
        parts.append(tagged)
    corpus = weighed(concat(parts), recipe, recipe.get("shuffle_keys", ["id"]))
    if recipe.get("shuffle", False):
        corpus = shuffle(corpus, recipe.get("shuffle_keys", ["id"]), recipe.get("seed", SEED))
    return corpus


def publish(corpus: DataFrame, recipe: dict[str, Any]) -> None:
    """Write by (config, split) when the recipe asks to publish, else as one plain table."""
    path = recipe.get("output_path", "combined_dataset")
    if recipe.get("publish", True):
        write_splits(corpus, path)
    else:
        save(corpus, path)
