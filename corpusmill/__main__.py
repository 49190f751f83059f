"""Run a job from a recipe: ``spark-submit -m corpusmill`` or ``python -m corpusmill``.

usage: corpusmill JOB --recipe FILE [--output PATH] [--labelled PATH] [--eos TEXT] [--key COLUMN ...]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.chat_mixture import build_mixture_from
from corpusmill.plans.corpus import build_corpus, publish
from corpusmill.plans.evaluation import evaluate_from
from corpusmill.plans.questions import build_question_sets, build_questions
from corpusmill.plans.recipe import load_recipe
from corpusmill.plans.training_text import build_chats_from_json, build_training_text_from
from corpusmill.session import RECOMMENDED
from corpusmill.streaming.sample import sample_stream_from

JOBS = (
    "corpus",
    "mixture",
    "questions",
    "question-sets",
    "training-text",
    "json-chat",
    "evaluate",
    "stream-sample",
)


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """Build the job's table, publish it where the recipe says, and return it."""
    parser = argparse.ArgumentParser(prog="corpusmill", description="Run a job from a recipe.")
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--recipe", required=True, help="YAML or JSON file")
    parser.add_argument("--output", help="instead of the recipe's output_path")
    parser.add_argument("--labelled", help="table (lang, text) to learn languages from")
    parser.add_argument("--eos", default="<|endoftext|>", help="end marker of training text")
    parser.add_argument("--key", nargs="+", default=["id"], help="columns that identify a chat")
    options = parser.parse_args(arguments)

    recipe = load_recipe(options.recipe)
    if options.output:
        recipe["output_path"] = options.output
    if options.job == "corpus":
        built = build_corpus(spark, recipe)
    elif options.job == "mixture":
        labelled = spark.read.parquet(options.labelled) if options.labelled else None
        built = build_mixture_from(spark, recipe, labelled)
    elif options.job == "questions":
        built = build_questions(spark, recipe)
    elif options.job == "question-sets":
        built = build_question_sets(spark, recipe)
        recipe["publish"] = False
    elif options.job == "json-chat":
        built = build_chats_from_json(spark, recipe)
    elif options.job == "evaluate":
        built = evaluate_from(spark, recipe)
        recipe["publish"] = False
    elif options.job == "stream-sample":
        return sample_stream_from(spark, recipe)  # the stream itself writes the table
    else:
        built = build_training_text_from(spark, recipe, options.key, options.eos)
    publish(built, recipe)
    return built


def main() -> None:
    import sys

    builder = SparkSession.builder.appName("corpusmill")
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    run(builder.getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
