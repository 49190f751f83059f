"""Counts and summaries of a table, each from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each successive filter, as (step, stage, n), from a single scan."""
    reached = F.lit(True)
    counts = [F.count(F.lit(1)).alias("c0")]
    names = ["all"]
    for i, (name, condition) in enumerate(stages, start=1):
        reached = reached & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(reached).alias(f"c{i}"))
        names.append(name)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"c{i}").alias("n"))
            for i, n in enumerate(names)
        ]
    )
    return df.agg(*counts).select(F.inline(rows))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def length_histogram(lengths: DataFrame, ordinary: int = 2) -> DataFrame:
    """How many conversations have each length other than the ordinary one."""
    return (
        lengths.where(F.col("n_messages") != ordinary)
        .groupBy("n_messages")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def length_profile(lengths: DataFrame, ordinary: int = 2) -> DataFrame:
    """Conversations of the ordinary length, and of all others, in one row."""
    return lengths.agg(
        F.count_if(F.col("n_messages") == ordinary).alias("n_ordinary"),
        F.count_if(F.col("n_messages") != ordinary).alias("n_other"),
    )


def bad_sources(lengths: DataFrame, ordinary: int = 2, column: str = "source") -> DataFrame:
    """Sources with at least one conversation of another length."""
    return lengths.where(F.col("n_messages") != ordinary).select(column).distinct()


def size_mb(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.sum(F.octet_length(column)) / F.lit(1048576)).alias("size_mb"))


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: name, type and number of nulls."""
    fields = list(enumerate(df.dtypes))
    counts = [F.count_if(F.col(f"`{name}`").isNull()).alias(f"c{i}") for i, (name, _) in fields]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("column_type"),
                F.col(f"c{i}").alias("null_count"),
            )
            for i, (name, kind) in fields
        ]
    )
    return df.agg(*counts).select(F.inline(rows))
