"""Evaluating multiple-choice items: score every option, choose one, report accuracy."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.scoring import (
    ITEM,
    BigramModel,
    accuracy_with_total,
    argmax_option,
    metrics_long,
    option_candidates,
    score_options,
    score_with_model,
    train_bigrams,
)
from corpusmill.plans.recipe import open_entry


def evaluate(items: DataFrame, model: BigramModel, length_scale: str = "reference") -> DataFrame:
    """(metric, value) for items (item, dataset, target, prompt, options) under a bigram model."""
    scores = score_options(items, ITEM, model, length_scale)
    return metrics_long(accuracy_with_total(argmax_option(scores)))


def evaluate_with(items: DataFrame, make_predict_fn: Callable) -> DataFrame:
    """The same with a caller's model scoring the candidate texts."""
    scores = score_with_model(option_candidates(items), make_predict_fn)
    return metrics_long(accuracy_with_total(argmax_option(scores)))


def evaluate_scores(scores: DataFrame) -> DataFrame:
    """The same from a table of scores (item, dataset, target, option_idx, score)."""
    return metrics_long(accuracy_with_total(argmax_option(scores)))


def evaluate_from(spark: SparkSession, recipe: dict[str, Any]) -> DataFrame:
    """Metrics of the recipe's first entry, a table of items, under a bigram model of the texts in
    ``train_text``; ``length_scale`` as in ``score_options``."""
    items = open_entry(spark, recipe["datasets"][0])
    model = train_bigrams(spark.read.parquet(recipe["train_text"]))
    return evaluate(items, model, recipe.get("length_scale", "reference"))
