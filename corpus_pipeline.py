"""A training corpus in five stages: language, near-duplicates, benchmark leaks, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on everything that the one before it kept. All but
the last return the columns of ``docs`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import packed, table
from corpusmill.llm.language import identify
from corpusmill.llm.leaks import without_leaks
from corpusmill.llm.mixing import mix
from corpusmill.llm.near import one_of_each
from corpusmill.llm.token_file import tokenised
from corpusmill.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null texts, texts without a letter, and longer texts that the
    closest language parses no better than its own letters in random order."""
    given, row = packed(docs, "doc_id", "text", "lang")
    return identify(given).where("recognised").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by the target weight of their source."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in files; one row for each document, from reading the files."""
    return tokenised(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
