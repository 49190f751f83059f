"""Column operators: rename, select, coerce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.schemas import PREFERENCES, conform, require_columns


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; an unknown source column raises, where Spark would ignore it."""
    require_columns(df, list(mapping))
    return df.withColumnsRenamed(mapping)


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*columns)


def to_int(value: Column) -> Column:
    """Numeric text -> int; text that is no number, not finite or out of range becomes null."""
    return value.try_cast("double").try_cast("int")


def clean_preferences(df: DataFrame) -> DataFrame:
    """Dirty question rows -> the declared types."""
    return conform(
        df.select(
            to_int(F.col("course_id")).alias("course_id"),
            to_int(F.col("question_id")).alias("question_id"),
            F.col("question_body").cast("string").alias("question_body"),
            F.col("question_answer").cast("string").alias("question_answer"),
            F.col("question_type").cast("string").alias("question_type"),
        ),
        PREFERENCES,
    )
