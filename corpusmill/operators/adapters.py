"""Differently shaped multiple-choice tables -> the canonical row, one projection each.

Adapters that number their rows need ``row_position`` on the input, taken at the scan and so
before any filter: ids keep the gaps that filtering leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import mcqa
from corpusmill.functions.constants import SEED, STEM_SUBJECTS
from corpusmill.operators.mixture import concat
from corpusmill.schemas import MCQA, conform

POSITION = "row_position"


@dataclass(frozen=True)
class Origin:
    """Where rows come from: dataset name, subset for the ids, split, and adapter options."""

    name: str
    subset: str
    split: str = "train"
    subjects: list[str] = field(default_factory=lambda: list(STEM_SUBJECTS))
    seed: int = SEED


def _row_id(origin: Origin, number: Column) -> Column:
    return F.concat(F.lit(origin.subset + "_"), number.cast("string"))


def _canonical(
    df: DataFrame,
    origin: Origin,
    question: Column,
    choices: Column,
    answer: Column,
    context: Column | None = None,
    number: Column | None = None,
) -> DataFrame:
    rows = df.select(
        F.lit(origin.name).alias("dataset"),
        _row_id(origin, F.col(POSITION) if number is None else number).alias("id"),
        question.alias("question"),
        choices.alias("choices"),
        answer.alias("answer"),
        (F.lit(None) if context is None else context).cast("string").alias("context"),
    )
    return conform(rows, MCQA)


def subject_questions(df: DataFrame, origin: Origin, label: str) -> DataFrame:
    """Questions of the allowed subjects, the subject being in column ``label``."""
    return _canonical(
        df.where(F.col(label).isin(origin.subjects)),
        origin,
        F.col("question"),
        F.col("choices"),
        mcqa.letter_at(F.col("answer")),
    )


def mmlu_auxiliary(df: DataFrame, origin: Origin) -> DataFrame:
    return subject_questions(df, origin, "task")


def mmlu(df: DataFrame, origin: Origin) -> DataFrame:
    return subject_questions(df, origin, "subject")


def arc(df: DataFrame, origin: Origin) -> DataFrame:
    """The answer key passes through, also when it is not a letter."""
    return _canonical(
        df,
        origin,
        F.col("question"),
        F.col("choices.text"),
        F.col("answerKey"),
        number=F.col("id"),
    )


def science_qa(df: DataFrame, origin: Origin) -> DataFrame:
    """Text-only closed-choice questions of natural science."""
    suitable = (
        F.col("image").isNull()
        & (F.col("subject") == "natural science")
        & (F.col("task") == "closed choice")
    )
    return _canonical(
        df.where(suitable),
        origin,
        F.col("question"),
        F.col("choices"),
        mcqa.letter_at(F.col("answer")),
    )


def math_qa(df: DataFrame, origin: Origin) -> DataFrame:
    return _canonical(
        df,
        origin,
        F.col("Problem"),
        mcqa.packed_choices(F.col("options")),
        mcqa.upper_letter(F.col("correct")),
        F.col("Rationale"),
    )


def openbook_qa(df: DataFrame, origin: Origin) -> DataFrame:
    return _canonical(
        df,
        origin,
        F.col("question_stem"),
        F.col("choices.text"),
        F.col("answerKey"),
        F.col("fact1"),
    )


def sciq(df: DataFrame, origin: Origin) -> DataFrame:
    """Three distractors and the answer in an order drawn per row; the first equal choice counts."""
    choices = F.array("distractor1", "distractor2", "distractor3", "correct_answer")
    mixed = df.withColumn("_choices", mcqa.shuffled(choices, origin.seed, F.col(POSITION)))
    at = mcqa.first_index(F.col("_choices"), F.col("correct_answer"))
    return _canonical(
        mixed,
        origin,
        F.col("question"),
        F.col("_choices"),
        mcqa.letter_at(at),
        F.col("support"),
    )


def med_mcqa(df: DataFrame, origin: Origin) -> DataFrame:
    return _canonical(
        df.where(F.col("choice_type") == "single"),
        origin,
        F.col("question"),
        F.array("opa", "opb", "opc", "opd"),
        mcqa.letter_at(F.col("cop")),
        F.col("exp"),
    )


# The public dataset that each adapter reads.
ADAPTERS: dict[str, Callable[[DataFrame, Origin], DataFrame]] = {
    "kz919/mmlu-auxiliary-train-auto-labelled": mmlu_auxiliary,
    "cais/mmlu": mmlu,
    "allenai/ai2_arc": arc,
    "derek-thomas/ScienceQA": science_qa,
    "allenai/math_qa": math_qa,
    "allenai/openbookqa": openbook_qa,
    "allenai/sciq": sciq,
    "openlifescienceai/medmcqa": med_mcqa,
}


def adapt(df: DataFrame, origin: Origin) -> DataFrame:
    """Canonical rows of one dataset, tagged with ``config`` and ``split``."""
    if origin.name not in ADAPTERS:
        raise ValueError(f"no adapter for {origin.name!r}; known: {sorted(ADAPTERS)}")
    return (
        ADAPTERS[origin.name](df, origin)
        .withColumn("config", F.lit(origin.subset))
        .withColumn("split", F.lit(origin.split))
    )


def adapt_all(inputs: list[tuple[DataFrame, Origin]]) -> DataFrame:
    return concat([adapt(df, origin) for df, origin in inputs])


def short_choice_lists(questions: DataFrame, expected: int) -> DataFrame:
    """How many questions per config have fewer choices than expected."""
    return questions.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("choices") < expected).alias("n_short"),
    )
